"""Steps whose cost must not outgrow their input, and results that must hold on inputs that made them fail."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators import boundary, calibration, contexts, encode, index, retrieval, themes
from tracewright.sources import markdown


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_screen_keeps_texts_in_place(spark):
    """Without anchors no text is shuffled or repeated for its sentences."""
    texts = spark.createDataFrame([(1, "It cost $5.\nFine. It cost $5."), (2, None), (3, ""), (4, "My mom had surgery. Depresyon!")], "id long, text string")
    out = boundary.screen(texts)
    assert not {"Exchange", "Generate"} & set(plan(out).replace("(", " ").split())
    got = {r.id: r for r in out.collect()}
    assert got[1].flagged == ["It cost $5."] * 2 and got[1].redacted == f"{boundary.MASK}\nFine. {boundary.MASK}"
    assert not got[2].safe and got[2].redacted == boundary.HELD and got[2].reasons == []
    assert got[3].safe and got[3].redacted == ""
    assert got[4].reasons == ["family+health", "health"]


def test_hash_encoder_without_cancelling(spark):
    """Two words of one bucket and opposite signs are a text with words, so its vector has length 1."""
    seen = {}
    for k in range(2000):
        at, sign = encode._bucket(f"w{k}", encode.DIMS)
        if (at, -sign) in seen:
            break
        seen[at, sign] = f"w{k}"
    text = f"{seen[at, -sign]} w{k}"
    assert np.isclose(np.linalg.norm(encode.hashed(text)), 1.0)
    got = spark.createDataFrame([(text,), ("...",), (None,)], "t string").select(encode.hash_encoder(F.col("t")).alias("v")).collect()
    assert [round(float(np.linalg.norm(r.v)), 3) for r in got] == [1.0, 0.0, 0.0]


def vectors(spark, x):
    return spark.createDataFrame([(k, None if v is None else [float(c) for c in v]) for k, v in enumerate(x)], "id long, v array<double>").repartition(3)


def unit_rows(n, dims, seed):
    x = np.random.default_rng(seed).standard_normal((n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("alpha", [1.0, 1.3, 1.5, 2.0])
@pytest.mark.parametrize("cue_bytes", [1 << 24, 500])
def test_weighed(spark, monkeypatch, alpha, cue_bytes):
    """Weights without a shuffled or joined pair: what gives them is one row a cue."""
    monkeypatch.setattr(retrieval, "CUE_BYTES", cue_bytes)
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 40)
    x = unit_rows(150, 6, 1)
    memory = vectors(spark, [*x, None])
    cues = memory.where("id % 10 = 0 and v is not null").select(F.col("id").alias("cue_id"), F.col("v").alias("q"))
    out = retrieval.weighed(memory.withColumn("label", F.col("id") % 3), cues, 8.0, alpha)
    # Pairs come out of the map over the memory and meet nothing after it.
    assert "MapInArrow" in plan(out) and not any(step in plan(out) for step in ("Join", "Window", "Aggregate"))
    got = {(r.cue_id, r.id): r for r in out.collect()}
    want = {10 * c: retrieval.entmax_rows(8.0 * (x @ x[10 * c])[None, :], alpha, 200)[0] for c in range(15)}
    assert len(got) == 15 * 151
    for (c, i), r in got.items():
        if i == 150:
            assert r.sim is None and r.w == (None if alpha == 1 else 0.0)
        else:
            assert abs(r.w - want[c][i]) < 1e-9 and abs(r.sim - x[i] @ x[c]) < 1e-12 and r.label == i % 3


def test_nearest_to_cues_ties(spark, monkeypatch):
    """Copies in different blocks are equally similar; the lower id comes first, as in the SQL."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 17)
    x = np.tile(unit_rows(11, 64, 2), (9, 1))
    memory = vectors(spark, x)
    cues = memory.where("id < 11").select(F.col("id").alias("cue_id"), F.col("v").alias("q"))
    got = {}
    for r in retrieval.nearest_to_cues(memory, cues, 4).collect():
        got.setdefault(r.cue_id, []).append(r.id)
    assert {c: sorted(i) for c, i in got.items()} == {c: [c, c + 11, c + 22, c + 33] for c in range(11)}


def test_supports_leave_blocks_only_near_the_top(spark, monkeypatch):
    """A block without the cue's nearest passes on nothing, where its own greatest would have let some pass."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 25)
    x = unit_rows(200, 64, 3)
    memory = vectors(spark, x)
    got = retrieval.supports(memory.select(F.col("id").alias("cue_id"), F.col("v").alias("q")), memory, 12.0, 1.5).count()
    assert got == (x @ x.T > (x @ x.T).max(axis=1, keepdims=True) - 1 / 6).sum() == 200
    sims = x @ x.T - 2 * np.eye(200)
    got = retrieval.supports(memory.select(F.col("id").alias("cue_id"), F.col("v").alias("q")), memory, 12.0, 1.5, itself=False).count()
    assert got == (sims > sims.max(axis=1, keepdims=True) - 1 / 6).sum()


def test_similarities_held_at_once():
    """However large a block, a task holds a bounded number of similarities."""
    assert all(retrieval.at_once(n) * n <= max(retrieval.HELD, n) and retrieval.at_once(n) >= 1 for n in (1, 300, 8192, 65536, 10**7))


def test_context_vectors_by_chunks(spark, monkeypatch):
    """The same vectors where the vocabulary is many chunks and a text's words are gone through in parts."""
    rows = [(k, f"the {'cat' if k % 2 else 'barge'} {['eats', 'sleeps', 'drifts'][k % 3]} and {['rests', 'waits'][k % 2]}. it is {k % 7}.") for k in range(90)]
    texts = spark.createDataFrame(rows, "id long, text string")
    model = contexts.learn(texts, dims=3)
    said = texts.select("id", F.col("text").alias("s"))
    one = {r.id: r.v for r in model.vectors(said).collect()}
    monkeypatch.setattr(contexts, "CHUNK", 3)
    monkeypatch.setattr(contexts, "GROUP", 8)
    parts = {r.id: r.v for r in model.vectors(said).collect()}
    again = contexts.learn(texts, dims=3)
    assert set(one) == set(parts) == set(range(90)) and all(np.allclose(one[k], parts[k]) for k in one)
    assert np.allclose(model.values, again.values)
    assert np.array_equal(contexts._added(np.array([0, 0, 2]), np.array([1, 2, 0]), None, np.eye(3), 4), [[0, 1, 1], [0, 0, 0], [1, 0, 0], [0, 0, 0]])


def test_context_steps_shuffle_nothing(spark, monkeypatch):
    """What is shuffled while an encoder is learned does not depend on the number of steps: entries and vectors are met as written."""
    seen = []
    monkeypatch.setattr(contexts, "CHUNK", 3)
    monkeypatch.setattr(contexts, "cut", lambda df, cut=contexts.cut: seen.append(plan(df).count("Exchange")) or cut(df))
    texts = spark.createDataFrame([(k, f"the {'cat' if k % 2 else 'barge'} {['eats', 'sleeps', 'drifts'][k % 3]} here.") for k in range(60)], "id long, text string")
    few = contexts.learn(texts, dims=3, steps=1), sum(seen)
    many = contexts.learn(texts, dims=3, steps=4), sum(seen) - few[1]
    assert few[1] == many[1] > 0 and len(many[0].values) == 3


def test_sentences_are_not_shuffled_for_contexts(spark):
    """Sentences that go to the anchors are numbers of words by then, so no join or group of the screen has their strings as key."""
    texts = spark.createDataFrame([(k, f"the {'cat' if k % 2 else 'barge'} {['eats', 'sleeps', 'drifts'][k % 3]} here. it is {k}.") for k in range(60)], "id long, text string")
    model = contexts.learn(texts, dims=3)
    anchors = boundary.encoded(spark.createDataFrame([(1, "the cat eats here.")], "id long, s string"), model).select(F.col("v").alias("a"))
    out = boundary.screen(texts, anchors, threshold=0.999999, encoder=model)
    assert not re.search(r"(Join|Exchange hashpartitioning|Aggregate)[^\n]*[\[(](s|meant)#", plan(out))
    got = {r.id: r.flagged for r in out.collect()}
    assert all(("the cat eats here." in got[k]) == (k % 2 == 1 and k % 3 == 0) for k in range(60))


def test_sections_of_one_file_in_many_tasks(spark):
    """The title of a file comes to its lines without bringing all of them to one task."""
    told = [(1, "# Big"), *[(k, f"## part {k}" if k % 5 == 0 else f"line {k} that is long enough to be kept as a body") for k in range(2, 200)]]
    rows = spark.createDataFrame([("a/big.md", k, line) for k, line in told], "path string, n long, line string").repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = markdown.sections_of(rows, "report")
        assert not re.search(r"Join \[path#\d+\], \[", plan(out))
        got = sorted(r.title for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted(["Big", *[f"Big — part {k}" for k in range(5, 200, 5)]])


def test_rounds_of_clusters_are_few():
    """A round has a fixed cost, so a round of a large group holds more rows than a group that one task does."""
    assert themes.BATCH >= 4 * themes.TASK_ROWS and themes.TASK_ROWS == 2048


def test_blocks_meet_without_a_shuffle(spark, monkeypatch):
    """Neither side is shuffled for the blocks of the other: both are read as they were written."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 30)
    x = unit_rows(200, 6, 4)
    memory = vectors(spark, [*x, None])

    def most(ids, sims, cols):
        return pd.DataFrame({"id": ids, "s": sims.max(axis=1), "n": sims.shape[1]})

    for others in (None, memory.where("id < 70")):
        out = retrieval.pairwise(memory, others, most, "id long, s double, n long")
        assert "CartesianProduct" in plan(out) and "Exchange" not in plan(out)
        n = 200 if others is None else 70
        got = out.groupBy("id").agg(F.max("s").alias("s"), F.sum("n").alias("n")).collect()
        assert len(got) == 200 and all(r.n == n and np.isclose(r.s, (x[:n] @ x[r.id]).max()) for r in got)
    assert retrieval.pairwise(memory, memory.limit(0), most, "id long, s double, n long").count() == 0


def test_a_task_adds_up_over_blocks(spark, monkeypatch):
    """However many blocks the memory has, a state leaves a task once, and what is written of it once a step."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 9)
    x = unit_rows(150, 6, 5)
    memory = retrieval.packed(vectors(spark, x))
    assert memory.parts == 17 and memory.table.count() <= 17
    rows = []
    real = retrieval.met
    monkeypatch.setattr(retrieval, "met", lambda *a, **k: rows.append(real(*a, **k)) or rows[-1])
    got = {r.id: r for r in retrieval.attended(vectors(spark, x), memory, 9.0).collect()}
    assert rows[0].count() == 150
    for k, r in got.items():
        e = np.exp(9.0 * (x @ x[k] - 1))
        assert np.isclose(r.m, 1) and np.isclose(r.t, e.sum()) and np.allclose(r.s, e @ x)
    assert len(got) == 150


def test_memory_of_a_task():
    """Two blocks and a few matrices of similarities: a worker's share of 4 GB for four has to hold them many times over."""
    assert 2 * retrieval.BLOCK_BYTES + 8 * 8 * retrieval.HELD <= 100 << 20


@pytest.mark.parametrize("block", [7, 20, 31])
def test_two_blocks_meet_once(spark, monkeypatch, block):
    """An AUC's pairs of blocks are half of all, whatever the number of blocks; each task has one histogram for all of its pairs."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", block)
    x = unit_rows(160, 5, 6)
    table = vectors(spark, x).withColumn("label", F.col("id") % 3)
    parts = retrieval.packed(table, spark.sparkContext.defaultParallelism).parts
    seen = []
    real = retrieval.met
    monkeypatch.setattr(calibration, "met", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    auc = calibration.label_auc(table).first()["auc"]
    i, j = np.triu_indices(160, 1)
    sims, same = (x @ x.T)[i, j], i % 3 == j % 3
    assert auc == pytest.approx((sims[same][:, None] > sims[~same]).mean(), abs=1e-5)
    hist = seen[0].groupBy("bin").agg(F.sum(F.col("p") + F.col("q")).alias("n"), F.count(F.lit(1)).alias("tasks"))
    assert hist.agg(F.sum("n")).first()[0] == 160 * 159 // 2
    assert hist.agg(F.max("tasks")).first()[0] <= parts


def test_known_tops_spare_a_pass(spark, monkeypatch):
    """The report of an index takes its greatest similarities from its calibration: one pass over all pairs, with the same result."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 40)
    x = unit_rows(120, 5, 7)
    x[50:60] = x[0]
    table = vectors(spark, x)
    passes = []
    real = retrieval.met
    monkeypatch.setattr(retrieval, "met", lambda *a, **k: passes.append(1) or real(*a, **k))
    want = {r.id: r for r in retrieval.separability(table, 12.0).collect()}
    assert len(passes) == 2
    got = {r.id: r for r in retrieval.separability(table, 12.0, two=retrieval.top_two(table)).collect()}
    assert len(passes) == 3 and set(got) == set(want) == set(range(120))
    assert all(np.isclose(got[k].top, want[k].top) and (got[k].rival, got[k].active) == (want[k].rival, want[k].active) for k in want)
    passes.clear()
    index.build(table.select("id", "v"))
    assert len(passes) == 1
