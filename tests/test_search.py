"""Exact neighbours by pivots, diverse recall by passes, greedy clusters by rounds: each against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import diverse, neighbours, retrieval, themes

VECTORS = "id long, v array<double>"


def clustered(rng, clusters, each, dims, spread=0.05):
    centers = rng.standard_normal((clusters, dims))
    x = np.repeat(centers / np.linalg.norm(centers, axis=1, keepdims=True), each, axis=0)
    x = x + spread * rng.standard_normal(x.shape)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, x, first=0):
    return spark.createDataFrame([(first + k, [float(c) for c in v]) for k, v in enumerate(x)], VECTORS).repartition(5)


def brute(x, y, k, itself):
    sims = x @ y.T
    if itself:
        np.fill_diagonal(sims, -np.inf)
    out = {}
    for i, row in enumerate(sims):
        order = sorted((j for j in range(len(row)) if row[j] > -np.inf), key=lambda j: (-round(row[j], 9), j))[:k]
        out[i] = [(row[j], j) for j in order]
    return out


def check(got, want):
    assert set(got) == set(want)
    for i, near in got.items():
        assert [round(s, 9) for s, _ in near] == [round(s, 9) for s, _ in want[i]]
        assert all(j == other or abs(s - t) < 1e-9 for (s, j), (t, other) in zip(near, want[i]))


def found(df):
    return {r.id: [(n.s, n.other) for n in r.near] for r in df.collect()}


@pytest.mark.parametrize("k", [1, 2, 3])
def test_clustered(spark, k):
    x = clustered(np.random.default_rng(k), 40, 50, 16)
    watch = {}
    check(found(neighbours.nearest(table(spark, x), k, cell=50, watch=watch)), brute(x, x, k, True))
    assert watch["pairs"] <= watch["all_pairs"] / 4


@pytest.mark.parametrize("case", ["random", "copies", "zeros", "lengths", "hot"])
def test_other_vectors(spark, case):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((600, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if case == "copies":
        x[100:400] = x[0]
    if case == "zeros":
        x[::7] = 0
    if case == "lengths":
        x *= rng.uniform(0.01, 5, (600, 1))
    if case == "hot":
        x[:400] = clustered(rng, 1, 400, 6, 0.001)
    check(found(neighbours.nearest(table(spark, x), 3, cell=40)), brute(x, x, 3, True))
    y = rng.standard_normal((90, 6))
    check(found(neighbours.nearest(table(spark, y), 2, table(spark, x), cell=40)), brute(y, x, 2, False))


def test_blocks(spark, monkeypatch):
    """Cells of more than one block, on either side. (The sizes of blocks are set on the driver.)"""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 30)
    x = clustered(np.random.default_rng(2), 3, 100, 8, 0.3)
    check(found(neighbours.nearest(table(spark, x), 2, cell=100)), brute(x, x, 2, True))


def test_few(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [None, 1.0])], VECTORS)
    assert found(neighbours.nearest(one, 3)) in ({}, {1: []})
    assert found(neighbours.nearest(one.limit(0), 3)) == {}
    two = spark.createDataFrame([(1, [1.0, 0.0]), (9, [0.6, 0.8])], VECTORS)
    assert found(neighbours.nearest(two, 3)) == {1: [(0.6, 9)], 9: [(0.6, 1)]}
    assert retrieval.top_two(two).where("s2 is null and s1 = 0.6").count() == 2


def plain_recall(x, priors, cues, k, beta, alpha, diversity):
    out = {}
    for c, q in enumerate(cues):
        sims = x @ q
        w = sims if beta is None else retrieval.entmax_rows(beta * sims[None, :], alpha, 200)[0]
        base = w + priors
        picks = retrieval.mmr(base, x, k, diversity)
        out[c] = [(int(i), w[i], sims[i], base[i]) for i in picks], int((w > retrieval.ACTIVE).sum())
    return out


@pytest.mark.parametrize("beta,alpha,diversity", [(12.0, 1.5, 0.5), (12.0, 1.0, 0.5), (30.0, 2.0, 0.3), (8.0, 1.3, 0.9), (None, 1.5, 0.5), (0.1, 1.5, 0.0)])
def test_diverse(spark, monkeypatch, beta, alpha, diversity):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 70)  # several blocks of traces and of cues
    rng = np.random.default_rng(11)
    x = clustered(rng, 12, 25, 8, 0.2)
    priors = rng.uniform(0, 0.3, len(x))
    cues = clustered(rng, 5, 18, 8, 0.3)
    memory = spark.createDataFrame([(k, [float(c) for c in v], float(p)) for k, (v, p) in enumerate(zip(x, priors))], "id long, v array<double>, prior double")
    asked = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(cues)], "cue_id long, q array<double>")
    got = {}
    for r in diverse.diverse(memory, asked, 4, beta, alpha, diversity).orderBy("cue_id", "pos").collect():
        got.setdefault(r.cue_id, []).append(r)
    want = plain_recall(x, priors, cues, 4, beta, alpha, diversity)
    assert set(got) == set(want)
    for c, rows in got.items():
        picks, active = want[c]
        assert [r.id for r in rows] == [p[0] for p in picks] and [r.pos for r in rows] == list(range(1, len(picks) + 1))
        assert all(np.allclose((r.w, r.sim, r.base), p[1:], atol=1e-9) for r, p in zip(rows, picks))
        assert all(r.active == (None if beta is None else active) for r in rows)


def test_diverse_edges(spark):
    memory = spark.createDataFrame([(1, [1.0, 0.0], 0.1), (2, [1.0, 0.0], 0.1), (3, None, 0.1), (4, [0.0, 1.0], None)], "id long, v array<double>, prior double")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "cue_id long, q array<double>")
    rows = diverse.diverse(memory, asked, 3, 12.0).orderBy("cue_id", "pos").collect()
    assert [(r.cue_id, r.pos, r.id) for r in rows] == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2)]
    assert diverse.diverse(memory.limit(0), asked, 3, 12.0).count() == 0
    assert diverse.diverse(memory, asked.limit(0), 3, 12.0).count() == 0


def greedy_table(spark, x, rng):
    rows = [(k, [float(c) for c in v], int(rng.integers(0, 40)), f"t{k}", 0) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>, len int, title string, grp int").repartition(4)


@pytest.mark.parametrize("threshold,spread,batch", [(0.55, 0.25, 60), (0.25, 0.6, 70), (0.99, 0.3, 100)])
def test_greedy_rounds(spark, threshold, spread, batch):
    rng = np.random.default_rng(batch)
    x = clustered(rng, 9, 25, 8, spread)
    x[17] = 0
    rows = greedy_table(spark, x, rng)
    want = themes.find_patterns(rows, threshold=threshold, least=2).orderBy("cluster").collect()
    got = themes.find_patterns(rows, threshold=threshold, least=2, task_rows=0, batch=batch).orderBy("cluster").collect()
    assert [(r.grp, r.cluster, r["size"], r.exemplar, r.members) for r in got] == [(r.grp, r.cluster, r["size"], r.exemplar, r.members) for r in want]
    assert np.allclose([r.cohesion for r in got], [r.cohesion for r in want])


def test_greedy_conflicts(spark):
    """With room for few contenders, a row whose listed ones have all moved ends its round."""
    rng = np.random.default_rng(5)
    x = clustered(rng, 30, 8, 4, 0.5)
    rows = greedy_table(spark, x, rng)
    want = themes.find_patterns(rows, threshold=0.3, least=1).collect()
    got = themes.find_patterns(rows, threshold=0.3, least=1, task_rows=0, batch=80, contenders=1).collect()
    assert sorted(r.members for r in got) == sorted(r.members for r in want)


def test_greedy_groups(spark):
    """Large groups go by rounds, small ones by a task each; too small ones give nothing."""
    rng = np.random.default_rng(6)
    rows = greedy_table(spark, clustered(rng, 6, 30, 6, 0.2), rng).withColumn("grp", F.when(F.col("id") < 100, 0).when(F.col("id") < 178, 1).otherwise(2))
    want = themes.find_patterns(rows, threshold=0.7).collect()
    got = themes.find_patterns(rows, threshold=0.7, task_rows=80, batch=32).collect()
    key = lambda r: (r.grp, r.cluster, r["size"], r.exemplar, r.members)
    assert sorted(map(key, got)) == sorted(map(key, want)) and {r.grp for r in got} == {0, 1}
