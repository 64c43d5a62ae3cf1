"""The divergence audit against plain counting, with its edge cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.helpers import duck, same
from tracewright.llm import divergence, oracles, queries

DOCS = "text string, lang string, source string"


def brute(rows, least=10, top=10):
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = {k: k + 32 for k in range(65, 91)}
    groups, df, count = set(), Counter(), Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(low) for t in pattern.findall(text or "")]
        count.update((lang, source, t) for t in terms)
        df.update((lang, t) for t in set(terms))
    kept = defaultdict(set)
    for (lang, t), n in df.items():
        if n >= least:
            kept[lang].add(t)
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted(s for x, s in groups if x == lang)
        v = len(kept[lang])
        share = lambda n, total: 1 + 10**9 * (n + 2) // (total + 2 * v)
        whole = {t: sum(count[lang, s, t] for s in sources) for t in kept[lang]}
        q = {t: share(n, sum(whole.values())) for t, n in whole.items()}
        p = {s: {t: share(count[lang, s, t], sum(count[lang, s, u] for u in kept[lang])) for t in kept[lang]} for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept[lang]), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept[lang] if count[lang, s, t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def run(spark, rows, parts=3, **how):
    return sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, DOCS).repartition(parts), **how).collect()))


def test_query(spark, small):
    got = queries.op13_divergence(spark, small).toPandas()
    assert set(got.part) == {"pair", "term"}
    same(got, duck(small).execute(oracles.DIVERGENCE).df())


def test_schema(spark, small):
    fields = [(f.name, f.dataType.simpleString()) for f in queries.op13_divergence(spark, small).schema]
    assert fields == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]


@pytest.mark.parametrize("least", [1, 3, 10])
def test_random(spark, least):
    rng = np.random.default_rng(least)
    rows = []
    for k in range(150):
        words = [f"t{chr(97 + w % 26)}{'É' * (w % 3)}X" for w in rng.zipf(1.3, int(rng.integers(0, 60))) % 400]
        rows.append((" ".join(words) + "-9" * (k % 4), ["en", "de", None, ""][k % 4], [None, "a", "B", "é"][int(rng.integers(0, 4))]))
    assert run(spark, rows, least=least) == brute(rows, least)


def test_small_blocks(spark, monkeypatch):
    """Blocks of a few bytes, and runs passed on before a task's end, change nothing. (In this process: workers keep the module's sizes.)"""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = [(" ".join(f"w{'abcdefghij'[int(x)]}" for x in rng.integers(0, 10, 30)), "en", f"s{k % 3}") for k in range(80)]

    def total(batches):
        out = Counter()
        for b in batches:
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["term"]] += np.array([r["documents"], r["n"]])
        return {k: tuple(v) for k, v in out.items()}

    def batches():
        for k in range(0, len(rows), 30):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[k : k + 30]]) for i in (1, 2, 0)], ["lang", "source", "text"])

    want = total(divergence.partial_runs(batches()))
    for name, value in (("BLOCK_BYTES", 100), ("HELD_RUNS", 20), ("HELD_TERMS", 3), ("BATCH", 2)):
        monkeypatch.setattr(divergence, name, value)
    many = list(divergence.partial_runs(batches()))
    assert total(many) == want and sum(b.num_rows for b in many) > len(want)


def test_scan_over_batches():
    """Runs and terms that go on from batch to batch."""
    import pyarrow as pa

    rows = sorted((lang, term, source, d, d + 1) for lang in ("a", "b") for term in ("x", "y", "z") for source in ("p", "q") for d in range(1, 5))
    names = ["lang", "term", "source", "documents", "n"]
    want = None
    for size in (100, 7, 3, 1):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + size])], names) for k in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in divergence.kept_runs(20)(iter(batches)) for r in b.to_pylist()]
        want = want or got
        assert got == want and len(got) == 12 and sum(r[-1] for r in got) == 6
    assert not list(divergence.kept_runs(21)(iter(batches)))


def test_edges(spark, odd, odd_rows, empty, wide):
    rows = [(r[1], r[2], r[3]) for r in odd_rows]
    for df in (odd, wide):
        for least in (1, 2):
            assert sorted(map(tuple, divergence.audit(df, least=least).collect())) == brute(rows, least)
    assert divergence.audit(empty).count() == 0
    # No language keeps a term: all pairs are equal, in the order of their names.
    assert sorted(map(tuple, divergence.audit(odd, least=100).collect())) == brute(rows, 100)


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    big = 9_000_000_000_000
    row = spark.range(1).select(divergence.share(F.lit(big), F.lit(3 * big + 1), F.lit(7)).alias("p"), divergence.apart(F.lit(1_000_000_001), F.lit(1)).alias("f")).first()
    assert row.p == 1 + 10**9 * (big + 2) // (3 * big + 1 + 14) and row.f == 10**18 // 1_000_000_002
