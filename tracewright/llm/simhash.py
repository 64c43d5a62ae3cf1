"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints: words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, 3-word shingles with
repeats, XXH64 (seed 42) of each; a bit is set if more than half of the hashes set it. A text of
one or two words has one shingle, a text without words (or null) the fingerprint 0.

Search: each distinct fingerprint emits all variants within half of the radius. Two fingerprints
within the radius share a variant, and all that share a variant lie within the (even) radius of
each other, so a star around the smallest of a bucket loses no link of the component. A bucket
holds at most as many distinct fingerprints as one ball has points, whatever the number of copies.

Null texts count as empty. Repeated rows each get their row. Rows with a null id take part; an
all-null group has a null component_id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import components, cut, least_of_component

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Bytes of text, and shingles, that are worked on at once.
BLOCK_BYTES, BLOCK_SHINGLES = 1 << 20, 1 << 18

#: The five primes of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(0x9E3779B185EBCA87),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63),
    np.uint64(0x27D4EB2F165667C5),
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _lane(x: np.ndarray) -> np.ndarray:
    return _rotl(x * P2, 31) * P1


def xxh64_slices(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the slices buf[start:start+length] as uint64. buf: uint8 with 8 spare bytes at its end."""
    u64 = np.ndarray(buf.size - 7, "<u8", buf, strides=(1,))
    u32 = np.ndarray(buf.size - 3, "<u4", buf, strides=(1,))
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(start.size, s + P5, np.uint64)
        rest, pos = length & 31, start + (length & ~31)
        wide = np.flatnonzero(length >= 32)
        if wide.size:
            wide = wide[np.argsort(length[wide] >> 5, kind="stable")]
            stripes, at = length[wide] >> 5, start[wide]
            acc = [np.full(wide.size, x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            for k in range(int(stripes[-1])):
                frm = np.searchsorted(stripes, k, "right")
                for j in range(4):
                    acc[j][frm:] = _rotl(acc[j][frm:] + u64[at[frm:] + (32 * k + 8 * j)] * P2, 31) * P1
            x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                x = (x ^ _lane(a)) * P1 + P4
            h[wide] = x
        h += length.astype(np.uint64)
        for k in range(3):
            on = np.flatnonzero(rest >= 8 * (k + 1))
            if on.size:
                h[on] = _rotl(h[on] ^ _lane(u64[pos[on] + 8 * k]), 27) * P1 + P4
        pos = pos + (rest & ~7)
        on = np.flatnonzero(rest & 4)
        if on.size:
            h[on] = _rotl(h[on] ^ (u32[pos[on]].astype(np.uint64) * P1), 23) * P2 + P3
        pos = pos + (rest & 4)
        for k in range(3):
            on = np.flatnonzero((rest & 3) > k)
            if on.size:
                h[on] = _rotl(h[on] ^ (buf[pos[on] + k].astype(np.uint64) * P5), 11) * P1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    return h


def simhash_block(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints (int64) of the texts data[offsets[i]:offsets[i+1]] in UTF-8."""
    n = offsets.size - 1
    counts = np.zeros((n, 64), np.int64)
    total = np.zeros(n, np.int64)
    if data.size:
        upper = (data >= 65) & (data <= 90)
        low = np.where(upper, data + 32, data).astype(np.uint8)
        white = (low == 32) | ((low >= 9) & (low <= 13))
        before = np.empty(low.size, bool)
        before[0], before[1:] = True, white[:-1]
        before[offsets[:-1][offsets[:-1] < low.size]] = True
        after = np.empty(low.size, bool)
        after[-1], after[:-1] = True, white[1:]
        ends = offsets[1:]
        after[ends[ends > 0] - 1] = True
        keep = ~white | ~before
        low[white] = 32
        where = np.cumsum(keep) - 1
        first = np.flatnonzero(~white & before)
        last = where[np.flatnonzero(~white & after)]
        doc = np.searchsorted(offsets, first, "right") - 1
        first = where[first]
        packed = np.concatenate([low[keep], np.zeros(8, np.uint8)])
        words = np.bincount(doc, minlength=n)
        word0 = np.cumsum(words) - words
        total = np.where(words >= SHINGLE_WORDS, words - SHINGLE_WORDS + 1, (words > 0).astype(np.int64))
        of = np.repeat(np.arange(n), total)
        nth = np.arange(of.size) - np.repeat(np.cumsum(total) - total, total)
        frm = word0[of] + nth
        to = frm + np.minimum(words, SHINGLE_WORDS)[of] - 1
        for k in range(0, of.size, BLOCK_SHINGLES):
            part = slice(k, k + BLOCK_SHINGLES)
            a = first[frm[part]]
            h = xxh64_slices(packed, a, last[to[part]] + 1 - a)
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            docs, heads = np.unique(of[part], return_index=True)
            counts[docs] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    out = np.packbits(2 * counts > total[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(out).view("<i8").ravel()


def text_blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of consecutive rows of a string column, each of about BLOCK_BYTES; null: empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    k = 0
    while k < len(column):
        to = max(k + 1, int(np.searchsorted(off, off[k] + BLOCK_BYTES, "right")) - 1)
        yield data[off[k] : off[to]], off[k : to + 1] - off[k]
        k = to


def fingerprints(df: DataFrame, text_col: str = "text", keep_text: bool = False, name: str = "fp") -> DataFrame:
    """`df` with the fingerprint as a long, without its text unless keep_text."""
    kept = [c for c in df.columns if keep_text or c != text_col]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [simhash_block(*x) for x in text_blocks(batch.column(len(kept)))]
            fp = np.concatenate(fp) if fp else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(fp, pa.int64())], [*kept, name])

    return source.mapInArrow(run, T.StructType([*[source.schema[c] for c in kept], T.StructField(name, T.LongType())]))


def ball(fp: F.Column, half: int) -> F.Column:
    """Array of all 64-bit values within `half` flipped bits of fp."""
    masks = [0]
    for k in range(1, half + 1):
        masks += [sum(1 << b for b in c) for c in combinations(range(64), k)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: fp.bitwiseXOR(m))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, hub): links whose components are those of all pairs within the radius. distinct: column fp."""
    if radius % 2:
        raise ValueError("the radius must be even: only then is every pair of a bucket within it")
    variants = distinct.select("fp", F.explode(ball(F.col("fp"), radius // 2)).alias("variant"))
    hub = F.min("fp").over(Window.partitionBy("variant"))
    pairs = variants.select("fp", hub.alias("hub")).where("fp <> hub").distinct()
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= radius)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of `df`: id, fingerprint (16 hex digits), component_id (smallest id reachable), group
    (a fingerprint of the component, also where all of its ids are null)."""
    fps = cut(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))))
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("low")))
    comp = components(fingerprint_links(nodes.select("fp"), radius), "fp", "hub")
    reach = cut(nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "low", "component"))
    named = least_of_component(reach, "component", "low", "component_id")
    named = named.select(F.col("fp").alias("fp_"), "component_id", F.coalesce("component", "fp").alias("component"))
    out = fps.join(named, fps.fp == named.fp_)
    return out.select(F.col("id").alias(id_col), digits("fp").alias("fingerprint"), "component_id", digits("component").alias("group"))


def digits(column: str) -> F.Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of `df` with the smallest id of their group: one row for each group. Of rows of a group that share that id, the one
    with the least text stays, and of equal texts the one whose other columns, as JSON, come first."""
    found = cut(near_duplicates(df, id_col, text_col, radius))
    keep = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(F.col(id_col).alias("__kept")).agg(F.count(F.lit(1)).alias("__n"))
    if keep.where("__n > 1").isEmpty():
        return df.join(keep, F.col(id_col).eqNullSafe(F.col("__kept")), "left_semi")
    # Ids that repeat, null ones included, don't tell rows apart: their groups do.
    groups = found.groupBy("fingerprint").agg(F.first("component_id").alias("component_id"), F.first("group").alias("group"))
    rows = fingerprints(df, text_col, keep_text=True, name="__fp").withColumn("__fp", digits("__fp"))
    rows = rows.join(groups.select(F.col("fingerprint").alias("__of"), F.col("component_id").alias("__first"), F.col("group").alias("__group")), F.col("__fp") == F.col("__of"))
    rows = rows.where(F.col(id_col).eqNullSafe(F.col("__first")))
    order = F.struct(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.to_json(F.struct(*df.columns)))
    kept = rows.groupBy("__group").agg(F.min_by(F.struct(*df.columns), order).alias("__row"))
    return kept.select(*[F.col("__row")[c].alias(c) for c in df.columns])
