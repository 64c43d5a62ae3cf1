"""SimHash, pieces, tokens, edit fingerprints and mixing against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.helpers import duck, same
from tracewright.llm import common, edits, mixing, oracles, pieces, queries, simhash, tokens


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def simhash_of(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(nodes, pairs):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_simhash(rows, radius=2):
    fps = [simhash_of(t) for _, t in rows]
    distinct = sorted(set(fps))
    comp = linked(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= radius])
    low = {}
    for (d, _), f in zip(rows, fps):
        if d is not None:
            low[comp[f]] = min(low.get(comp[f], d), d)
    return Counter((d, f"{f:016x}", low.get(comp[f])) for (d, _), f in zip(rows, fps))


def test_simhash_brute(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # near copies: one word changed
    rng = random.Random(1)
    for k in range(60):
        w = words(rows[k][1])
        if len(w) > 30:
            w[rng.randrange(len(w))] = "other"
            rows.append((10_000 + k, " ".join(w)))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()) == brute_simhash(rows)


def test_simhash_query(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.op1_simhash(spark, small)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()) == brute_simhash(rows)


def test_simhash_edges(spark, odd, odd_rows, empty, wide):
    want = brute_simhash([(r[0], r[1]) for r in odd_rows])
    for table in (odd, wide):
        got = simhash.near_duplicates(table).collect()
        assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0
    # one row of each group stays, also where ids repeat or are missing
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert len({simhash_of(r["text"]) for r in kept.collect()}) == kept.count() == len({simhash_of(r[1]) for r in odd_rows})
    # which row stays doesn't depend on the order of rows
    again = simhash.one_of_each(spark.createDataFrame(odd_rows[::-1], odd.schema).repartition(5))
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))
    with pytest.raises(ValueError):
        simhash.fingerprint_links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_ball_links_whole_chains(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(20)]
    for k in range(60):
        x = fps[rng.randrange(len(fps))]
        for _ in range(rng.choice([1, 2, 2, 3])):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    comp = {r["node"]: r["component"] for r in common.components(links, "fp", "hub").collect()}
    mask = (1 << 64) - 1
    want = linked(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & mask).bit_count() <= 2])
    assert {f: comp.get(f, f) for f in fps} == want


def test_components(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, 101), (100, 102), (7, 7)] + [(100, 101)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(path, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_pieces_equal_the_library(spark, small, odd, odd_rows, empty, wide):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = queries.op9_pieces(spark, small).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in got:
        ids = lib.encode(texts[r["doc_id"]], num_threads=1)
        assert r["n_pieces"] == len(ids) and r["decoded_ok"]
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    want = Counter((r[0], tuple(lib.encode(r[1] or ""))) for r in odd_rows)
    for table in (odd, wide):
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in pieces.encode_table(table).collect()) == want
    assert pieces.encode_table(empty).count() == 0


def test_pieces_on_random_strings():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    with open(pieces.default_model(), "rb") as f:
        v = pieces.Vocabulary(f.read())
    e, rng = pieces.Encoder(v), random.Random(2)
    texts = ["", " ", " " * 50, "a" * 90, "\0\n\t", "x" + " " * 33 + "y"]
    texts += ["".join(rng.choice("ab ▁eét.\n1☃") for _ in range(rng.randrange(50))) for _ in range(200)]
    texts += ["".join(rng.choice(v.usable) for _ in range(rng.randrange(15))) for _ in range(300)]
    ids, counts = e.encode(texts)
    ends = np.concatenate([[0], np.cumsum(counts)])
    for i, t in enumerate(texts):
        mine = ids[ends[i] : ends[i + 1]]
        assert mine.tolist() == lib.encode(t), t
        assert pieces.decode(v, mine) == t.replace("▁", " ")


def test_token_counts(spark, small, odd, odd_rows, empty, wide):
    import base64

    import tiktoken

    with open(tokens.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("t", pat_str=tokens._pattern(), mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op6_tokens(spark, small).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {d: len(lib.encode_ordinary(t)) for d, t in texts.items()}
    want = Counter((r[0], len(lib.encode_ordinary(r[1] or ""))) for r in odd_rows)
    for table in (odd, wide):
        assert Counter((r["doc_id"], r["n_tokens"]) for r in tokens.counts(table).collect()) == want
    assert tokens.counts(empty).count() == 0
    minus = spark.createDataFrame([(-5, "a"), (-(2**62), "b c"), (2**62, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in tokens.counts(minus).collect()} == {-5, -(2**62), 2**62}
    ends = spark.createDataFrame([(-(2**63), "least"), (2**63 - 1, "greatest"), (None, "none")], "doc_id long, text string")
    assert {r["doc_id"] for r in tokens.counts(ends).collect()} == {-(2**63), 2**63 - 1, None}
    names = spark.createDataFrame([("12", "a number"), ("x1", "a name")], "doc_id string, text string")
    assert {r["doc_id"] for r in tokens.counts(names).collect()} == {12, None}
    # A long text has a file of its own and is counted whole.
    long = spark.createDataFrame([(k, "word " * n) for k, n in enumerate((30_000, 3, 60_000, 0))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.counts(long).collect()} == {k: len(lib.encode_ordinary("word " * n)) for k, n in enumerate((30_000, 3, 60_000, 0))}


@pytest.mark.parametrize("block", [2, 4, 6, 50])
def test_scan_stitches_blocks_and_parts(spark, block):
    rng = random.Random(block)
    stream = [rng.choice([9, 9, 9, 7]) for _ in range(97)]  # 7 separates
    docs, cur = [], []
    for t in stream:
        if t == 7:
            docs.append(cur)
            cur = []
        else:
            cur.append(t)
    docs += [cur] if cur else []
    cuts = [0, 13, 14, 40, 97]
    parts = [("s", k, bytearray(np.array(stream[a:b], "<u2").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = tokens.scan(spark.createDataFrame([*parts, ("e", 0, bytearray())], "stream string, part int, content binary"), separator=7, block=block, header=2).collect()
    assert sorted((r["nth"], r["tokens"], r["head"]) for r in got) == [(k, len(d), d[:2]) for k, d in enumerate(docs)]


def test_edits_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    texts = [r["text"] for r in docs]
    changed = [t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][: len(t) // 2] for k, t in enumerate(texts)]
    own, new = edits.fingerprints(texts), edits.fingerprints(changed)
    got = {r["doc_id"]: r for r in queries.op7_edits(spark, small).collect()}
    assert len(got) == len(texts)
    for k, d in enumerate(docs):
        r = got[d["doc_id"]]
        assert r["n_chars"] == len(texts[k]) and r["edited_sha256"] == hashlib.sha256(changed[k].encode()).hexdigest()
        assert r["fingerprint"] == own[k].tobytes().hex() and r["edited_fingerprint"] == new[k].tobytes().hex()
        assert r["near_edited"] == pytest.approx(edits.likeness(own[k : k + 1], new[k : k + 1])[0])
        assert r["near_next"] == pytest.approx(edits.likeness(own[k : k + 1], own[[(k + 1) % len(texts)]])[0])
        assert 0 <= r["near_next"] <= 1 and (r["near_edited"] > r["near_next"] or texts[k] == texts[(k + 1) % len(texts)])
    by_text = {}
    for k, d in enumerate(docs):
        by_text.setdefault(texts[k], set()).add((got[d["doc_id"]]["fingerprint"], got[d["doc_id"]]["component_id"]))
    assert all(len(v) == 1 for v in by_text.values())


def test_edits_walk_forgives_shifts():
    rng = random.Random(0)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    shifted, other = "xx" + base[:1500] + base[1501:], "".join(rng.choice("abcdefgh ") for _ in range(3000))
    fp = edits.fingerprints([base, shifted, other, base])
    assert (fp[0] == fp[3]).all() and edits.likeness(fp[:1], fp[1:2])[0] > 0.8 > 0.4 > edits.likeness(fp[:1], fp[2:3])[0]
    many = edits.fingerprints([base] + ["q" * k for k in range(60)])
    assert (many[0] == fp[0]).all()  # whatever stands beside it


def scalar_walk(text):
    """The fingerprint as the docstring defines it, one step at a time."""
    total = [0] * edits.BITS
    at = step = 0
    while at < len(text):
        p = ord(text[at])
        move = int(edits.STEPS[step % edits.PERIOD, (p ^ (p >> 8) * 37) % edits.END])
        sign = 1 if move & 2 else -1
        if step < edits.HEAD:
            for b in range(edits.BITS):
                total[b] += sign * int(edits.SPREAD[step, b])
        else:
            total[step % edits.BITS] += edits.WEIGHT * sign
        at += move & 1
        step += 1
    return sum(1 << b for b in range(edits.BITS) if total[b] > 0).to_bytes(edits.BITS // 8, "little").hex()


def test_walk_by_single_steps():
    rng = random.Random(3)
    texts = ["", "a", "Üé😀", "x" * 500, *("".join(rng.choice("abc deé\n☃😀") for _ in range(rng.choice([3, 90, 400, 3000]))) for _ in range(60))]
    assert [f.tobytes().hex() for f in edits.fingerprints(texts)] == [scalar_walk(t) for t in texts]


def near_parts(fps):
    """The least place of each fingerprint's component, over all pairs."""
    bits = np.unpackbits(fps, axis=1).astype(np.float32)
    off = bits @ (1 - bits.T) + (1 - bits) @ bits.T
    near = np.argwhere(np.triu(np.cos(np.pi * off / edits.BITS) >= edits.LIKE, 1))
    root = linked(range(len(fps)), [(int(a), int(b)) for a, b in near])
    return [root[k] for k in range(len(fps))]


def test_edits_components_brute(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).orderBy("doc_id").collect()
    fps = edits.fingerprints([r["text"] for r in rows])
    want = {rows[k]["doc_id"]: rows[root]["doc_id"] for k, root in enumerate(near_parts(fps))}
    got = edits.fingerprint_table(spark.createDataFrame(rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_bands_find_pairs_up_to_the_threshold(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 256, (150, edits.BITS // 8), dtype=np.uint8)
    bits = np.unpackbits(base, axis=1)
    for k in range(len(bits)):
        bits[k, rng.choice(edits.BITS, 30 + k % 45, replace=False)] ^= 1  # 30 to 74 bits
    fps = np.concatenate([base, np.packbits(bits, axis=1)])
    prints = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(fps)], "node long, fingerprint binary").repartition(3)
    pairs = set()
    plan = edits.band_plan(len(fps))
    for k in range(0, plan[1], edits.BANDS_AT_ONCE):
        pairs |= {(r["hub"], r["node"]) for r in edits.band_links(prints, plan, range(k, min(k + edits.BANDS_AT_ONCE, plan[1]))).collect()}
    near = {(k, k + 150) for k in range(150) if 30 + k % 45 <= 73}
    assert edits.MOST_OFF == 73 and pairs <= near and len(pairs) >= 0.97 * len(near)
    assert {p for p in near if 30 + p[0] % 45 <= 55} <= pairs


@pytest.mark.parametrize("n,bits", [(0, 18), (250_000, 18), (16 << 20, 21), (50_000_000_000, 32)])
def test_band_plan_keeps_recall_and_crowds_bounded(n, bits):
    plan = edits.band_plan(n)
    assert plan[0] == bits and n / 2 ** plan[0] < 2**edits.CROWD
    rng = np.random.default_rng(1)
    few = np.stack([rng.choice(edits.BITS, edits.MOST_OFF, replace=False) for _ in range(2000)])
    off = np.zeros((len(few), edits.BITS), bool)
    np.put_along_axis(off, few, True, axis=1)
    found = np.zeros(len(few), bool)
    for at in edits.samples(*plan):
        found |= ~off[:, at].any(axis=1)
    assert found.mean() > 0.95


@pytest.mark.parametrize("size", [5, 40, 700])
def test_members_of_a_band_are_all_compared(size):
    """Chains and pairs beside an unrelated least member."""
    rng = np.random.default_rng(size)
    bits = rng.integers(0, 2, (size, edits.BITS), dtype=np.uint8)
    for k in range(2, size):
        if k % 7:
            bits[k] = bits[k - 1]
            bits[k, rng.choice(edits.BITS, 50 + k % 20, replace=False)] ^= 1
    fps = np.packbits(bits, axis=1, bitorder="little")[np.append(0, 1 + rng.permutation(size - 1))]
    a, b = edits.alike(np.zeros(size, np.int64), fps.view("<u8"))
    got = linked(range(size), zip(a.tolist(), b.tolist()))
    assert [got[k] for k in range(size)] == near_parts(fps) and len(set(got.values())) < size


def test_edits_edges(spark, monkeypatch, odd, odd_rows, empty, wide):
    n = 0
    for table in (odd, wide):
        got = edits.fingerprint_table(table).collect()
        n = len(got)
        assert n == len(odd_rows)
        order = sorted(((r[0], r[1] or "") for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want = Counter((d, len(t), hashlib.sha256(edits.edited(t, order[(k + 1) % n][1]).encode()).hexdigest()) for k, (d, t) in enumerate(order))
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    # more buckets than ids, and one bucket
    for size in (1, 1 << 40):
        monkeypatch.setattr(edits, "BUCKET_BYTES", size)
        again = edits.fingerprint_table(odd).collect()
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in again) == want
    assert edits.fingerprint_table(empty).count() == 0
    one = edits.fingerprint_table(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_mixing_query(spark, small):
    same(queries.op8_mixing(spark, small).toPandas(), duck(small).execute(oracles.MIXING).df())


def test_mixing_edges(spark, odd, odd_rows, empty, wide):
    import duckdb

    con = duckdb.connect()
    table = pd.DataFrame([(r[0], r[1], r[3]) for r in odd_rows], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con.register("documents", table)
    want = con.execute(oracles.MIXING).df()
    for t in (odd, wide):
        got = mixing.mix(t)
        same(got.drop("copies", "hash").toPandas().astype({"doc_id": "Int64"}), want)
        assert got.where("taken > 2 * size").count() == 0
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(blank).collect()] == [0, 0]


def test_rows_that_share_an_id_are_taken_each_for_itself(spark):
    rows = [(k % 7, f"text {k} " + "w " * (k % 11), f"s{k % 3}") for k in range(200)]
    table = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string")
    plan = mixing.mix(table).toPandas()
    want = Counter()
    by_size = plan.groupby(["doc_id", "source", "size"])["copies"].sum()
    for r in mixing.taken(table).collect():
        want[r["doc_id"], r["source"], len(r["text"].split())] += 1
    assert {k: n for k, n in want.items()} == {k: n for k, n in by_size.items() if n}
    assert len(set(plan.copies)) > 1


def test_targets_are_shared_again(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 7}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = ["a", "b", "c", None]
    weight = dict(zip(names, (3, 1, 2, 3)))
    free, left, want = set(names), 1.5 * sum(sizes.values()), {}
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            want |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            want[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    assert {s: pytest.approx(x) for s, x in want.items()} == got


def test_taken_words_come_near_the_target(spark):
    rng = random.Random(4)
    rows = [(k, "w " * rng.randrange(1, 60), f"s{k % 3}") for k in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("x")).collect():
        assert abs(r["t"] - r["x"]) <= 30
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7))
    assert sorted((r["doc_id"], r["taken"]) for r in got.collect()) == sorted((r["doc_id"], r["taken"]) for r in again.collect())
