"""Substring dedup against counting all windows, with its edge cases."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import duck, same
from tracewright.llm import oracles, queries, repeats

DOCS = "doc_id long, text string"


def brute(rows, window=35):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=4, **how):
    df = spark.createDataFrame(rows, DOCS).repartition(parts)
    out = repeats.remove_repeats(df, **how).select("doc_id", "n_words", "n_removed", "kept_sha256")
    return sorted(map(tuple, out.collect()), key=str)


def test_query(spark, small):
    got = queries.op12_repeats(spark, small).toPandas()
    assert got.n_removed.sum() > 0
    same(got, duck(small).execute(oracles.REPEATS).df())


@pytest.mark.parametrize("vocabulary", [1, 2, 3, 50, 5000])
def test_random_texts(spark, vocabulary):
    """Few words give runs, periods and self-overlaps; many give passages that stand in different places."""
    rng = np.random.default_rng(vocabulary)
    word = lambda n: [f"w{k}" for k in rng.integers(0, vocabulary, n)]
    shared = [word(n) for n in (34, 35, 36, 50, 90)]
    rows = []
    for k in range(60):
        text = word(int(rng.integers(0, 120)))
        for passage in shared:
            if rng.random() < 0.3:
                at = int(rng.integers(0, len(text) + 1))
                text = text[:at] + passage + text[at:]
        rows.append((k, " ".join(text)))
    rows.append((100, " ".join(["a", "b"] * 60 + ["a"] * 70 + ["a", "b", "c"] * 30)))
    rows.append((101, " ".join(word(60) + ["x"] + word(35) + shared[3])))
    assert run(spark, rows) == brute(rows)


def test_shift_by_one(spark):
    """A passage one word too short, just long enough, at the ends and next to itself."""
    p = [f"p{k}" for k in range(80)]
    rows = [(1, " ".join(p)), (2, " ".join(p[:34] + ["q"])), (3, " ".join(["r"] + p[10:45])), (4, " ".join(p[45:])), (5, " ".join(["s"] * 3 + p[40:76] + p[40:76]))]
    got = run(spark, rows)
    assert got == brute(rows)
    assert [r[2] for r in got] == [len(p) - 10, 0, 35, 35, 72]


def test_edges(spark):
    long = " ".join(f"{k % 701}x{k % 13}" for k in range(40_000))
    p = " ".join(f"p{k}" for k in range(40))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, p), (None, None), (4, p + " x"), (5, p.replace(" ", "\n\n")), (6, "é  " * 50), (7, long), (8, "short " * 34), (8, "short " * 34), (9, p.upper())]
    rows += [(20 + k, f"{p} {k}") for k in range(300)] + [(1000, "copy of " + p + " y")] * 3
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, rows[:3]) == brute(rows[:3])


def test_columns(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(k % 2, 40)), "kept", 7, "d") for k in range(4)]
    df = spark.createDataFrame(rows, "id long, text string, k string, n_words int, `a.b` string")
    out = repeats.remove_repeats(df)
    assert out.columns == ["id", "text", "k", "a.b", "n_words", "n_removed", "kept_sha256", "kept"]
    assert out.where("k = 'kept' and n_removed = n_words and kept = ''").count() == 4


def test_anchors_follow_the_window():
    """Every window has an anchor inside it, and equal windows have the same one at the same place, whatever stands around them."""
    rng = np.random.default_rng(4)
    for vocabulary in (1, 2, 4, 1000):
        texts = [" ".join(f"w{k}" for k in rng.integers(0, vocabulary, int(rng.integers(35, 200)))).encode() for _ in range(40)]
        part = texts[0].split()[:40]
        texts += [b" ".join(t.split()[: k * 3] + part + t.split()[k:]) for k, t in enumerate(texts)]
        first, names, _ = repeats.word_names(texts)
        starts, name, place = repeats.anchors(names, first)
        words = [w for t in texts for w in t.split()]
        seen = {}
        for s, n, p in zip(starts, name, place):
            assert s <= p < s + 35
            assert seen.setdefault(tuple(words[s : s + 35]), (n, p - s)) == (n, p - s)
        assert len(starts) == sum(max(0, len(t.split()) - 34) for t in texts)


def test_other_windows(spark):
    rng = np.random.default_rng(9)
    rows = [(k, " ".join(f"w{j}" for j in rng.integers(0, 6, 40))) for k in range(30)]
    for window in (1, 2, 5):
        assert run(spark, rows, window=window) == brute(rows, window)
    df = spark.createDataFrame(rows, DOCS).withColumn("kept_sha256", F.lit("x"))
    assert repeats.remove_repeats(df).where("kept_sha256 = 'x'").count() == 0
