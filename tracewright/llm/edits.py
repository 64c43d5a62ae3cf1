"""Document fingerprints by a randomised edit embedding.

A walk shared by all texts reads one character at each step, writes a bit that depends on step and
character, and then stays or moves on, which also depends on step and character. After an insertion or
deletion two walks fall into step again, so texts with few edits write nearly the same string: edit distance
becomes Hamming distance. The fingerprint of BITS bits folds that string: bit b is the sign of the sum of the
steps that fall to it (the first HEAD steps count in all bits with random signs, so short texts fill
theirs too). The angle between fingerprints estimates the share of steps that agree: likeness
max(0, cos(pi * differing bits / BITS)). Equal texts have equal fingerprints.

Near copies: BANDS samples of bits are grouped by their values (bit-sampled banding); all members of a group are
compared with each other, except those that its links join already, and each component that a group has is passed on
as a star. The stars of all bands give the components. `band_plan` sizes the bands: as many bits as keep
unrelated fingerprints of a group few whatever their number, and as many bands as find a pair at the very limit of
LIKE with the probability RECALL, nearer ones with more. Bands are worked on BANDS_AT_ONCE at a time, which
bounds the disk.

Whole texts are walked. Null and empty texts have the fingerprint 0. Ties of the id are ordered by text,
null ids come first; the text after the last is the first. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, least_of_component, roots

BITS, HEAD, PERIOD, SEED = 512, 256, 4096, 20240501
LIKE, RECALL = 0.9, 0.98
#: Fewest bits of a band; unrelated fingerprints of a group, as a power of two.
LEAST_BAND_BITS, CROWD = 18, 4
#: Bytes of text that one task walks, and most tasks.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 10_000
#: Bands that are shuffled at a time; members of a group up to which all pairs are taken at once; rows compared at a time.
BANDS_AT_ONCE, FEW, ROWS_AT_ONCE = 16, 16, 256
#: Steps between two looks at which walks have ended, walks below which each goes on alone,
#: characters and rows of a block.
STRIDE, ALONE, BLOCK, BLOCK_ROWS = 256, 40, 6 << 20, 4000
END = 255

_rng = np.random.default_rng(SEED)
#: By step and character class: bit 0 moves on, bit 1 is the sign; 4 after the end.
STEPS = _rng.integers(0, 4, (PERIOD, 256), dtype=np.uint8)
STEPS[:, END] = 4
ROWS = [r.tobytes() for r in STEPS]
SPREAD = (_rng.integers(0, 2, (HEAD, BITS)) * 2 - 1).astype(np.float32)
#: A later step weighs as much as a head step does in all bits together; whole numbers keep sums exact.
WEIGHT = round(BITS**0.5)
VALUE = np.array([-1, -1, 1, 1, 0], np.int32)
#: Differing bits that LIKE admits.
MOST_OFF = max(d for d in range(BITS // 2) if np.cos(np.pi * d / BITS) >= LIKE)


def _classes(text: str) -> np.ndarray:
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.append(((p ^ (p >> 8) * 37) % END).astype(np.uint8), np.uint8(END))


def fingerprints(texts: list[str]) -> np.ndarray:
    """(texts, BITS / 8) bytes."""
    n = len(texts)
    out = np.zeros((n, BITS // 8), np.uint8)
    if not n:
        return out
    size = np.array([len(t) for t in texts])
    order = np.argsort(-size, kind="stable")
    parts = [_classes(texts[i]) for i in order]
    cls = np.concatenate(parts)
    ends = np.cumsum([p.size for p in parts]) - 1
    pos = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    acc = np.zeros((BITS, n), np.int32)
    live = np.flatnonzero(size[order] > 0)
    step, written = 0, np.empty((STRIDE, n), np.uint8)
    while live.size >= ALONE or (live.size and step < HEAD):
        at, wrote = pos[live], written[:, : live.size]
        for k in range(STRIDE):
            row = wrote[k]
            STEPS[(step + k) % PERIOD].take(cls.take(at), out=row)
            at += row & 1
        pos[live] = at
        value = VALUE[wrote]
        if step < HEAD:
            acc[:, live] += (SPREAD[step : step + STRIDE].T @ value.astype(np.float32)).astype(np.int32)
        else:
            to = step % BITS
            acc[to : to + STRIDE, live] += WEIGHT * value
        step += STRIDE
        live = live[cls[at] != END]
    if live.size:
        raw = cls.tobytes()
        for i in live:
            at, j, wrote = int(pos[i]), step, bytearray()
            while (c := raw[at]) != END:
                v = ROWS[j % PERIOD][c]
                wrote.append(v)
                at += v & 1
                j += 1
            value = np.zeros(-(-(step % BITS + len(wrote)) // BITS) * BITS, np.int32)
            value[step % BITS : step % BITS + len(wrote)] = VALUE[np.frombuffer(bytes(wrote), np.uint8)]
            acc[:, i] += WEIGHT * value.reshape(-1, BITS).sum(axis=0, dtype=np.int32)
    out[order] = np.packbits(acc.T > 0, axis=1, bitorder="little")
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    off = np.unpackbits(a ^ b, axis=1).sum(axis=1)
    return np.maximum(0.0, np.cos(np.pi * off / BITS))


def band_plan(n: int) -> tuple[int, int]:
    """(bits of a band, bands) for n distinct fingerprints."""
    bits = max(LEAST_BAND_BITS, max(n, 1).bit_length() - CROWD)
    shared = math.comb(BITS - MOST_OFF, bits) / math.comb(BITS, bits)
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - shared))


@functools.cache
def samples(width: int, count: int) -> np.ndarray:
    """The sampled bits of each band."""
    rng = np.random.default_rng(SEED + width)
    return np.stack([rng.choice(BITS, width, replace=False) for _ in range(count)])


def bands(fp: np.ndarray, plan: tuple[int, int], which: range) -> np.ndarray:
    """(texts, bands) longs: number of the band and the values of its sampled bits."""
    bits = np.unpackbits(fp, axis=1, bitorder="little").astype(float)
    powers = 2.0 ** np.arange(plan[0])
    keys = np.stack([bits[:, samples(*plan)[k]] @ powers for k in which], axis=1).astype(np.int64)
    return keys + (np.array(which) << plan[0])


def edited(text: str, following: str) -> str:
    """The last half of the characters replaced by as many of the next text's first, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _in_order(df: DataFrame) -> DataFrame:
    """(id, text, bucket, after) dealt out by bucket of the id and sorted; each bucket ends with a row of the
    next bucket's first text (after = 1). Bucket bounds are quantiles of the ids, as many as the bytes of
    text ask for; the driver sees one id of each bucket, and the text is shuffled once."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = [k / MOST_BUCKETS for k in range(1, MOST_BUCKETS)]
    size, cuts = df.select(F.sum(F.octet_length("text").cast("long")), F.percentile_approx("id", every, MOST_BUCKETS)).first()
    n = min(MOST_BUCKETS, max(least, -(-(size or 0) // BUCKET_BYTES)))
    cuts = sorted({cuts[k * MOST_BUCKETS // n - 1] for k in range(1, n)}) if cuts else []
    # How many cuts are there up to the id? By halves: powers of two, the greatest first.
    halves = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    step = lambda low, p: F.when(F.get(F.lit(cuts), low + p - 1) <= F.col("id"), low + p).otherwise(low)
    bucket = F.aggregate(halves, F.lit(0), step) + 1 if cuts else F.lit(1)
    rows = df.withColumn("bucket", F.when(F.col("id").isNull(), 0).otherwise(bucket).cast("int"))
    first = rows.groupBy("bucket").agg(F.min("id").alias("first")).orderBy("bucket").collect()
    if not first:
        return rows.withColumn("after", F.lit(0))
    # One row a bucket.
    heads = F.broadcast(spark.createDataFrame([(first[k][0], first[k - 1][0], first[k][1]) for k in range(len(first))], f"b int, before int, head {df.schema['id'].dataType.simpleString()}"))
    lead = rows.join(heads, (rows.bucket == heads.b) & rows.id.eqNullSafe(F.col("head"))).groupBy("before").agg(F.min(F.struct("id", "text")).alias("x"))
    lead = lead.select("x.id", "x.text", F.col("before").alias("bucket"), F.lit(1).alias("after"))
    every = rows.withColumn("after", F.lit(0)).unionByName(lead)
    return every.repartitionById(len(cuts) + 2, F.col("bucket")).sortWithinPartitions("bucket", "after", "id", "text")


def compared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Digest and fingerprints are binary here."""
    docs = _in_order(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    kind = docs.schema["id"].dataType
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def emit(ids: list, texts: list[str]) -> pa.RecordBatch:
        """texts has one more than ids: what follows the last."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        fp = fingerprints(texts + changed)
        own, nxt, mine = fp[: len(ids)], fp[1 : len(texts)], fp[len(texts) :]
        return pa.RecordBatch.from_arrays(
            [
                ids_type(ids),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in changed]),
                pa.array([x.tobytes() for x in own]),
                pa.array([x.tobytes() for x in mine]),
                pa.array(likeness(own, mine)),
                pa.array(likeness(own, nxt)),
            ],
            names,
        )

    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind.simpleString())

    def ids_type(ids: list) -> pa.Array:
        return pa.array(ids, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for k in range(len(batch)):
                text = batch.column(1)[k].as_py()
                texts.append(text)
                size += len(text)
                if batch.column(3)[k].as_py():  # what follows the bucket's last
                    yield emit(ids, texts)
                    ids, texts, size = [], [], 0
                    continue
                if ids and (size >= BLOCK or len(ids) >= BLOCK_ROWS):
                    yield emit(ids, texts)
                    ids, texts, size = [], [text], len(text)
                ids.append(batch.column(0)[k].as_py())

    schema = f"id {kind.simpleString()}, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    return docs.mapInArrow(run, schema)


def band_keys(prints: DataFrame, plan: tuple[int, int], which: range) -> DataFrame:
    """(key, node, fingerprint) for each of the bands of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), BLOCK_ROWS):
                node, prints = (c.slice(k, BLOCK_ROWS) for c in batch.columns)
                fp = np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(-1, BITS // 8)
                at = pa.array(np.repeat(np.arange(len(fp)), len(which)))
                yield pa.RecordBatch.from_arrays([pa.array(bands(fp, plan, which).ravel()), node.take(at), prints.take(at)], ["key", "node", "fingerprint"])

    return prints.select("node", "fingerprint").mapInArrow(run, "key long, node long, fingerprint binary")


def alike(key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of links among rows sorted by key: those of each key are joined as all of its pairs within MOST_OFF
    would join them, by as many links as it takes. words: fingerprints as (rows, BITS / 64) uint64."""
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(heads, len(key)))
    few = np.repeat(sizes <= FEW, sizes)
    left, right = [], []
    for off in range(1, FEW):
        a = np.flatnonzero((key[off:] == key[:-off]) & few[off:])
        if not a.size:
            break
        # Most pairs differ too much in the first words already.
        for part in (slice(0, 3), slice(0, None)):
            a = a[np.bitwise_count(words[a, part] ^ words[a + off, part]).sum(axis=1, dtype=np.int32) <= MOST_OFF]
        left.append(a)
        right.append(a + off)
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        at, ab = np.unique(np.concatenate([a, b]), return_inverse=True)
        star = at[roots(at.size, ab[: a.size], ab[a.size :])]
        left, right = [star[star < at]], [at[star < at]]
    for head, size in zip(heads[sizes > FEW], sizes[sizes > FEW]):
        rest, reached = np.arange(head, head + size), []
        while rest.size:
            # What was reached is compared with all that wasn't yet.
            if reached:
                now, reached = np.array(reached[:ROWS_AT_ONCE]), reached[ROWS_AT_ONCE:]
            else:
                now, rest = rest[:1], rest[1:]
            apart = np.zeros((now.size, rest.size), np.uint16)
            for w in range(words.shape[1]):
                apart += np.bitwise_count(words[now, w][:, None] ^ words[rest, w])
            near = apart <= MOST_OFF
            found = near.any(axis=0)
            left.append(now[near[:, found].argmax(axis=0)])
            right.append(rest[found])
            reached += rest[found].tolist()
            rest = rest[~found]
    return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (left, right))


def band_links(prints: DataFrame, plan: tuple[int, int], which: range) -> DataFrame:
    """(node, hub): links of the groups of the bands."""

    def links(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        key, node, fp = (pa.chunked_array([b.column(k) for b in rows]) for k in range(3))
        words = np.frombuffer(b"".join(fp.to_pylist()), "<u8").reshape(-1, BITS // 64)
        node = node.to_numpy()
        a, b = alike(key.to_numpy(), words)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(node[a], node[b])), pa.array(np.minimum(node[a], node[b]))], ["node", "hub"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last key's rows wait for the next batch
            if last or (held and held[-1].column(0)[-1].as_py() != key[-1]):
                yield links([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield links(held)

    dealt = band_keys(prints, plan, which).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "node long, hub long").distinct()


def fingerprint_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`compared` in hexadecimal, with component_id: the smallest id among near copies found by banding."""
    rows = cut(compared(df, id_col, text_col))
    prints = cut(rows.groupBy("fingerprint").agg(F.min("id").alias("low")).withColumn("node", F.monotonically_increasing_id()))
    plan, linked = band_plan(prints.count()), None
    for k in range(0, plan[1], BANDS_AT_ONCE):
        found = cut(band_links(prints, plan, range(k, min(k + BANDS_AT_ONCE, plan[1]))))
        linked = found if linked is None else linked.unionByName(found)
    comp = components(linked, "node", "hub").withColumnRenamed("node", "c")
    named = cut(prints.join(comp, prints.node == comp.c, "left").select("fingerprint", "low", "component"))
    named = least_of_component(named, "component", "low", "component_id").select(F.col("fingerprint").alias("f"), "component_id")
    out = rows.join(named, rows.fingerprint == named.f)
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    return out.select(F.col("id").alias(id_col), "n_chars", *hexed, "near_edited", "near_next", "component_id")
