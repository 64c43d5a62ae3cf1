"""The encoder learned from word contexts and the screen that uses it, against a dense NumPy run."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tracewright.functions.text import sentences
from tracewright.operators import boundary, contexts
from tracewright.plans import catalog

WORD = regex.compile(r"[\p{L}\p{N}]+")


def dense(texts, lines, dims, steps, start, reach=contexts.REACH, least=contexts.LEAST):
    """(word -> row, vectors, weights) by whole matrices. start: word -> first block."""
    words = [WORD.findall((t or "").lower()) for t in texts]
    df, n = Counter(w for ws in words for w in set(ws)), Counter(w for ws in words for w in ws)
    known = {w for w in df if df[w] >= least}
    total = sum(n[w] for w in known)
    counts = Counter()
    for line in lines:
        ws = WORD.findall(line.lower())
        for i, a in enumerate(ws):
            for b in ws[i + 1 : i + 1 + reach]:
                if a in known and b in known:
                    counts[a, b] += 1
                    counts[b, a] += 1
    sums = Counter()
    for (a, _), c in counts.items():
        sums[a] += c
    whole = sum(sums.values())
    cells = {(a, b): x for (a, b), c in counts.items() if (x := math.log(c * whole / (sums[a] * sums[b]))) > 0}
    rows = {w: k for k, w in enumerate(sorted({a for a, _ in cells}))}
    m = np.zeros((len(rows), len(rows)))
    for (a, b), x in cells.items():
        m[rows[a], rows[b]] = x
    q = np.array([start[w] for w in rows])
    for _ in range(steps):
        q = m @ np.linalg.qr(q)[0]
    q = np.linalg.qr(q)[0]
    e, u = np.linalg.eigh(q.T @ m @ q)
    best = np.argsort(-np.abs(e))[:dims]
    vectors = q @ u[:, best] * np.sqrt(np.abs(e[best]))
    return rows, vectors, {w: contexts.RARE / (contexts.RARE + n[w] / total) for w in rows}, e[best]


def encode(text, rows, vectors, weights):
    got = [w for w in WORD.findall((text or "").lower()) if w in rows]
    v = sum((weights[w] * vectors[rows[w]] for w in got), np.zeros(vectors.shape[1]))
    return v / (np.linalg.norm(v) or 1.0)


def test_screen_equals_dense(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    passages = spark.read.parquet(f"{small}/benchmark.parquet").select(F.col("item_id").alias("id"), F.col("text").alias("s"))
    model = contexts.learn(docs)
    first = {r.word: r.v for r in model.words.select("word", contexts.start(F.col("word"), contexts.DIMS + contexts.SPARE).alias("v")).collect()}
    split = docs.select("id", F.explode(sentences(F.col("text"))).alias("s")).collect()
    rows, vectors, weights, values = dense([r.text for r in docs.collect()], [r.s for r in split], contexts.DIMS, contexts.STEPS, first)
    assert set(rows) == set(first) and np.allclose(sorted(np.abs(model.values)), sorted(np.abs(values)), rtol=1e-6)
    anchors = np.array([encode(r.s, rows, vectors, weights) for r in passages.collect()])
    near = {s: float((anchors @ encode(s, rows, vectors, weights)).max()) for s in {r.s for r in split}}
    a = boundary.encoded(passages, model).select(F.col("v").alias("a"))
    got = {r.s: r.near for r in boundary.near_anchors(spark.createDataFrame([(s,) for s in near], "s string"), a, -2.0, model).collect()}
    assert {s for s in near if near[s]} == set(got)
    # The cut among eigenvalues that nearly tie leaves the last dimensions less certain than rounding.
    assert max(abs(got[s] - near[s]) for s in got) < 1e-4
    want = {s for s, x in near.items() if x >= catalog.NEAR_PASSAGE}
    clear = {s for s, x in near.items() if abs(x - catalog.NEAR_PASSAGE) > 1e-4}
    flagged = {s for r in boundary.screen(docs, a, threshold=catalog.NEAR_PASSAGE, encoder=model).collect() for s, why in zip(r.flagged, r.reasons) if why == "meaning"}
    assert want and flagged & clear == want & clear


def test_like_company(spark):
    """Words that never meet, but stand in the same places, are near; texts without a shared word too."""
    rng = np.random.default_rng(1)
    kinds = {"pet": (["cat", "dog", "hamster"], ["purrs", "eats", "sleeps", "plays"]), "ship": (["frigate", "barge", "tanker"], ["sails", "docks", "drifts", "anchors"])}
    rows = []
    for k in range(400):
        nouns, verbs = kinds["pet" if k % 2 else "ship"]
        rows.append((k, " ".join(f"the {rng.choice(nouns)} {rng.choice(verbs)} and {rng.choice(verbs)}." for _ in range(3))))
    model = contexts.learn(spark.createDataFrame(rows, "id long, text string"), dims=4)
    texts = spark.createDataFrame([(1, "cat"), (2, "dog"), (3, "barge"), (4, "tanker"), (5, "zebra"), (6, None), (7, "")], "id long, s string")
    v = {r.id: np.array(r.v) for r in model.vectors(texts).collect()}
    assert set(v) == {1, 2, 3, 4}
    assert v[1] @ v[2] > 0.9 and v[3] @ v[4] > 0.9 and max(v[1] @ v[3], v[2] @ v[4]) < 0.5
    held = boundary.screen_or_hold(spark.createDataFrame([(1, "The hamster sleeps. The weather is fine."), (2, "The frigate docks."), (3, None)], "id long, text string"), ["cat"], encoder=model, threshold=0.8)
    got = {r.id: r for r in held.collect()}
    assert not got[1].safe and got[1].flagged == ["The hamster sleeps."] and got[1].redacted == f"{boundary.MASK} The weather is fine."
    assert got[2].safe and not got[3].safe


def test_nothing_to_learn(spark):
    for rows in ([], [(1, None), (2, ""), (3, "few words")]):
        model = contexts.learn(spark.createDataFrame(rows, "id long, text string"))
        assert model.words.count() == 0 and model.vectors(spark.createDataFrame([(1, "few")], "id long, s string")).count() == 0


def test_held_if_the_screen_fails(spark):
    def broken(_):
        raise RuntimeError("no encoder")

    said = []
    got = boundary.screen_or_hold(spark.createDataFrame([(1, "fine")], "id long, text string"), encoder=broken, log=said.append).collect()
    assert len(got) == 1 and not got[0].safe and got[0].redacted == boundary.HELD and "no encoder" in said[0]


@pytest.mark.parametrize("text,n", [("a b a", 1), ("", 0), (None, 0)])
def test_words(spark, text, n):
    got = spark.createDataFrame([(text,)], "t string").select(contexts.words_of(F.col("t")).alias("w")).first().w
    assert Counter(got)["b"] == n and not re.search("None", "".join(got))
