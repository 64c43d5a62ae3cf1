"""The whole run, its records, engines elsewhere, indexes, channels and sampled pairs."""

import numpy as np
import pytest

from tracewright.operators import calibration, encode, index, retrieval
from tracewright.plans import answer, engines, fixtures, loop
from tracewright.sources import channels, registry


def _items(spark):
    return [r.asDict() for r in fixtures.frame(spark, "rubric").collect()]


def test_fixture_texts_share_no_bucket():
    v = np.stack([encode.hashed(t[1]) for t in fixtures.CUES])
    assert np.abs(v @ v.T - np.eye(3)).max() < 0.4  # far enough apart for one weight of 1


def test_answer_goes_on_without_context_and_holds_nulls(spark):
    said = []

    def broken():
        raise OSError("no pool")

    cues = spark.createDataFrame([(1, "harbor boats sail at dawn"), (2, None)], "cue_id long, cue string")
    gold = index.build(fixtures.frame(spark, "gold"), beta=12.0)
    assert answer.recall_context(cues, broken, log=said.append) is None and "no pool" in said[0]
    got = {r["cue_id"]: r for r in answer.answer(cues, gold, loop.StubEngine(), _items(spark), loop.LoopConfig(k=1), broken).collect()}
    assert set(got) == {1, 2} and got[1]["context_used"] == [] and got[1]["gold_used"] == ["Boats"]
    # No context: stakes .5, grounding .5, three of four rounds.
    assert got[1]["path"] == "fast" and got[1]["iterations"] == 2 and not got[1]["accepted"]
    none = answer.answer(cues.limit(0), gold, loop.StubEngine(), _items(spark))
    assert none.count() == 0


def test_records(spark, tmp_path):
    runs = [loop.run_loop("trust", loop.StubEngine(), _items(spark)), loop.run_loop("trust", loop.StubEngine(), _items(spark), loop.LoopConfig(max_iter=1))]
    rows = answer.archive_records(loop.rounds_frame(spark, runs), "rubric.md", "stub")
    path = str(tmp_path / "archive")
    for _ in range(2):
        registry.append_log(rows, path, ["date"])
    back = spark.read.json(path)
    assert back.count() == 4 and back.select("id").distinct().count() == 4
    assert {(r["run_id"], r["clean"], r["rounds"], r["final_draft"]) for r in back.collect()} == {(0, True, 3, "Draft about trust"), (1, False, 1, "Draft about trust [em_dash] [list]")}


def test_calls_back_off():
    waits, answers = [], [engines.CallFailed(429, 7.0), engines.CallFailed(429, 500.0), engines.CallFailed(503), engines.CallFailed(), " text "]

    def send(system, prompt):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    def engine(**more):
        return engines.CallingEngine(send, sleep=waits.append, draw=lambda low, high: high, **more)

    assert engine().complete("generate", "p") == "text" and waits == [7.0, 60.0, 4.0, 8.0]
    for bad, n in ((engines.CallFailed(400), 0), (engines.Refused("no"), 0), ("  ", 0), (engines.CallFailed(500), 2)):
        waits.clear()
        answers[:] = [bad] * 9
        with pytest.raises(engines.EngineError):
            engine(max_retries=2).complete("generate", "p")
        assert len(waits) == n and len(answers) == 8 - n


def test_hand_off(tmp_path):
    def reply(_):
        for asked in tmp_path.glob("*.request.txt"):
            assert asked.read_text() == "generate\np"
            (tmp_path / asked.name.replace("request", "response")).write_text(" done \n")

    engine = loop.build_engine(loop.LoopConfig(engine="handoff"), folder=str(tmp_path))
    engine.sleep = reply
    assert engine.complete("generate", "p") == "done" and not list(tmp_path.iterdir())
    engine.sleep, engine.ceiling = lambda _: None, 4.0
    with pytest.raises(engines.EngineError):
        engine.complete("generate", "p")
    assert not list(tmp_path.iterdir())
    assert isinstance(loop.build_engine(loop.LoopConfig(engine="call"), send=lambda s, p: p), engines.CallingEngine)


def test_index(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id id", "text body", "source channel", "double(doc_id % 10) salience").limit(40)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    built = index.build(rows, cache=str(tmp_path / "cache"))
    v = {r["id"]: np.array(r["v"]) for r in built.traces.collect()}
    ids = sorted(v)
    sims = np.stack([v[i] for i in ids]) @ np.stack([v[i] for i in ids]).T
    np.fill_diagonal(sims, -np.inf)
    best = -np.sort(-sims, axis=1)
    gap = (best[:, 0] - best[:, 1]).mean()
    assert built.beta == pytest.approx(min(40, max(4, np.log(6) / gap)) if gap >= 1e-4 else 20, rel=1e-5)
    cues = spark.createDataFrame([(7, rows.first()["body"])], "cue_id long, cue string")
    got = built.recall(cues, 2).collect()
    assert len(got) == 2 and all(r["body"] for r in got)
    q = spark.createDataFrame([(7, encode.hashed(rows.first()["body"]).tolist())], "cue_id long, q array<double>")
    plain = retrieval.recall(built.traces.select("id", "v", "date", "salience", "channel_weight"), q, 2, built.beta)
    assert {r["id"] for r in got} == {r["id"] for r in plain.collect()}
    with pytest.raises(ValueError):
        index.build(rows.limit(0))


def test_channels_over_a_tree(spark, tmp_path, monkeypatch):
    for path, content in fixtures.FILES:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    every = channels.channels(str(tmp_path))
    got = {(r["channel"], r["source"]) for r in registry.load_all(spark, every).collect()}
    want = {(r["channel"], r["source"]) for r in registry.load_all(spark, channels.channels("", files=fixtures.frame(spark, "files"))).collect()}
    assert got == want and {c for c, _ in got} == {"writing", "decision", "report", "projectdoc", "idea", "desktop"}
    assert registry.load_all(spark, every, ["notes"]).count() == 0
    monkeypatch.setenv("TRACEWRIGHT_NOTES_DIR", str(tmp_path / "w" / "other"))
    assert [r["source"] for r in registry.load_all(spark, every, ["notes"]).collect()] == ["notes:c"]


def test_sampled_pairs(spark, small):
    v = spark.read.parquet(f"{small}/embeddings.parquet").selectExpr("vec_id * 1000003 id", "cast(embedding as array<double>) v", "label")
    v = v.where("v is not null")
    a = calibration.sampled_pairs(v, 2000, 3)
    rows = a.collect()
    n = v.count()
    assert 2000 * (1 - 6 / n) < len(rows) <= 2000 and all(r["i"] != r["j"] for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, calibration.sampled_pairs(v.repartition(5), 2000, 3).collect()))
    label = {r["id"]: r["label"] for r in v.collect()}
    assert all(r["same"] == (label[r["i"]] == label[r["j"]]) for r in rows)
    assert calibration.sampled_pairs(v.limit(0), 10).count() == 0
    whole = calibration.pair_auc(calibration.label_pairs(v)).first()["auc"]
    assert calibration.pair_auc(a).first()["auc"] == pytest.approx(whole, abs=0.08)
