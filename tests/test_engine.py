"""Cache, logs, streaming, learning and the loop."""

import json

import numpy as np
import pytest

from pyspark.sql import functions as F

from tracewright.operators import boundary, encode, learn
from tracewright.plans import fixtures, loop
from tracewright.sources import registry, rubric
from tracewright.streaming import episodes


def test_cache_second_pass_misses_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, "")], "id long, text string")
    first = {r["id"]: r["embedding"] for r in encode.encode_cached(rows, path).collect()}
    n = encode.Store(spark, path).read().count()
    assert n == 3 and first[1] == first[2]
    assert encode.misses(rows, encode.Store(spark, path).read(), "hash64").count() == 0
    encode.encode_cached(rows, path).collect()
    assert encode.Store(spark, path).read().count() == n


def test_store_under_many_writers(spark, tmp_path):
    """Two writers of the same keys at once and one that was killed: one row a key, before and after the store is made one folder."""
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "store")
    texts = spark.createDataFrame([(k, f"text number {k % 20}") for k in range(60)] + [(99, None)], "id long, text string")
    with ThreadPoolExecutor(2) as pool:
        got = [f.result() for f in [pool.submit(lambda: encode.encode_cached(texts, path).count()) for _ in range(2)]]
    assert got == [61, 61]
    store = encode.Store(spark, path)
    rows = store.read()
    assert rows.count() == 21 == rows.select("model", "text_sha1").distinct().count()
    rows.limit(5).write.parquet(f"{path}/data/killed-before-its-commit")
    (tmp_path / "store" / "commits" / "_killed.tmp").write_text("{")
    assert store.read().count() == 21
    store.add(rows.limit(7))  # the same rows once more
    before = {r.text_sha1: r.embedding for r in store.read().collect()}
    assert len(before) == 21 and len(store.names()) >= 2
    store.compact()
    assert len(store.names()) == 1 and {r.text_sha1: r.embedding for r in store.read().collect()} == before
    assert encode.encode_cached(texts, path).count() == 61 and len(store.names()) == 1
    assert encode.encode_cached(texts, path, model="other").count() == 61 and store.read().count() == 42
    assert encode.encode_cached(texts.limit(0), str(tmp_path / "none")).count() == 0


def test_gradient():
    rng = np.random.default_rng(0)
    net = learn.IdentityEncoder.new(6, hidden=5, out=4)
    net.weights["w2"] = rng.standard_normal((5, 4)) * 0.3
    x, g = rng.standard_normal((8, 6)), np.array([0, 0, 1, 1, 2, 2, 3, 4])
    z, memo = net.forward(x)
    _, dz = learn.supcon(z, g)
    grads = net.backward(memo, dz)
    for name, at in (("bridge", (2, 1)), ("w1", (3, 2)), ("w2", (1, 1)), ("b1", (2,)), ("b2", (0,))):
        w = net.weights[name]
        old, step = w[at], 1e-6
        w[at] = old + step
        up = learn.supcon(net.forward(x)[0], g)[0]
        w[at] = old - step
        down = learn.supcon(net.forward(x)[0], g)[0]
        w[at] = old
        assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-5


def test_statistics_cover_all_rows(spark):
    """Groups that only rows beyond the 2000th have."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2300, 6))
    g = np.where(np.arange(2300) < 2000, np.arange(2300) % 3, 3 + np.arange(2300) // 100)
    x[2000:] += rng.standard_normal((30, 6))[g[2000:]]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, x[k].tolist(), int(g[k])) for k in range(len(x))], "id long, v array<double>, gid long")
    assert learn.supcon_loss(rows).first()["loss"] == pytest.approx(learn.supcon(x, g)[0], abs=1e-9)
    i, j = np.triu_indices(len(x), 1)
    sims, same = (x @ x.T)[i, j], g[i] == g[j]
    want = np.searchsorted(np.sort(sims[~same]), sims[same]).mean() / (~same).sum()
    assert learn.auc(x, g) == pytest.approx(want, abs=1e-9)
    assert learn.whole_auc(rows, None) == pytest.approx(want, abs=1e-7)  # similarities within 2e-6 count as ties


def test_training_beats_raw_on_planted_groups():
    rng = np.random.default_rng(1)
    groups = np.repeat(np.arange(8), 40)
    signal = rng.standard_normal((8, 4))[groups]
    x = np.concatenate([signal * 0.4, rng.standard_normal((320, 28))], axis=1)
    test = rng.random(320) < 0.25
    net, report = learn.train(x, groups, test, epochs=120, lr=5e-3, batch=64, out=16, hidden=32)
    assert report.improved and report.learned_auc > 0.6
    again = learn.IdentityEncoder.load(net.dump())
    assert np.allclose(again.forward(x)[0], net.forward(x)[0]) and learn.IdentityEncoder.load(None) is None
    r = learn.quant_report(net, learn.Int8Encoder.of(net), x[test], groups[test])
    assert r["fidelity_held"] and r["size_ratio"] > 3


def test_loop_and_choice(spark):
    items = [r.asDict() for r in fixtures.frame(spark, "rubric").collect()]
    run = loop.run_loop("x", loop.StubEngine(), items)
    assert run.accepted and [r["n_fail"] for r in run.rounds] == [2, 1, 0]

    class Broken:
        def complete(self, system, prompt):
            return "no json" if system == "critique" else "draft"

    run = loop.run_loop("x", Broken(), items)
    assert not run.accepted and len(run.rounds) == 4 and run.best_fail == sum(r["weight"] for r in items)
    with pytest.raises(ValueError):
        loop.build_engine(loop.LoopConfig(engine="other"))


def test_context_block_quotes_only_what_is_known_safe(spark):
    hits = spark.createDataFrame([(1, 1, "a", "n", False), (1, 2, "b", "", None), (1, 3, "c", None, True), (1, 4, "d", None, False)], "cue_id int, pos int, body string, note string, sensitive boolean")
    assert loop.context_block(hits).first()["context"] == "--- sample ---\n[why: n]\na\n\n--- sample ---\nd"


def test_screen_uses_every_anchor(spark):
    said = "Ailemle yaşadığım özel, kişisel, mahrem bir an."
    texts = spark.createDataFrame([(1, said), (2, "The mill stands by the river.")], "id long, text string")
    got = {r["id"]: r for r in boundary.screen(texts, boundary.anchor_vectors(spark)).collect()}
    assert got[1]["reasons"] == ["meaning"] and not got[1]["safe"] and got[1]["redacted"] == boundary.MASK and got[2]["safe"]
    far = [([1.0 if k == d else 0.0 for k in range(encode.DIMS)],) for d in range(encode.DIMS)]
    mine = encode.hashed("The mill stands by the river.").tolist()
    many = spark.createDataFrame([*[(f[0],) for f in far], (mine,)], "a array<double>").coalesce(1)
    assert not {r["id"]: r["safe"] for r in boundary.screen(texts, many, threshold=0.99).collect()}[2]


def test_stream_is_idempotent(spark, tmp_path):
    source, stores, log = (str(tmp_path / x) for x in ("in", "stores", "log"))
    (tmp_path / "in").mkdir()
    long = "word " * 50
    rows = [
        {"id": 1, "text": long, "cue": "c", "passed": 2, "items": 2, "human_approved": True},
        {"id": 2, "text": " " + long, "cue": "c", "passed": 2, "items": 2, "human_approved": True},
        {"id": 3, "text": long + "x", "cue": "c", "passed": 10, "items": 10, "human_approved": False},
        {"id": 4, "text": "thin", "cue": "c"},
    ]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    episodes.stream(spark, source, stores, log, str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in" / "2.json").write_text("\n".join(map(json.dumps, rows)))
    episodes.stream(spark, source, stores, log, str(tmp_path / "cp")).awaitTermination()
    kept = {(r["store"], r["id"]) for r in spark.read.parquet(stores).collect()}
    assert kept == {("gold", 1), ("candidate", 3)}
    assert spark.read.json(log).count() == 8


def test_rubric_errors():
    good = fixtures.RUBRIC_TEXT
    for bad in ("no header", good.replace("### A.", "### X."), good.replace("### B.", "### X."), good.replace("**", "")):
        with pytest.raises(rubric.RubricError):
            rubric.parse(bad)
    r = rubric.parse(good, keys={"backbone": ("k1",)}, weights={"k1": 2.5})
    assert [i[1] for i in r.items] == ["k1", "one_thesis", "no_em_dash", "no_list"] and r.items[0][5] == 2.5 and len(r.gate) == 2


def test_registry(spark, tmp_path):
    rows = spark.createDataFrame([("t", "b" * 40, "LinkedIn"), ("u", "short", "x")], "title string, body string, channel string")
    channels = [registry.Channel("writing", lambda s: rows), registry.Channel("notes", lambda s: rows, enabled=False)]
    assert registry.load_all(spark, channels).count() == 1
    assert {r["channel"] for r in registry.load_all(spark, channels, ["notes"]).collect()} == {"notes"}
    assert registry.load_all(spark, channels, []) is None
    registry.append_log(rows, str(tmp_path / "log"))
    registry.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    with pytest.raises(Exception):
        (tmp_path / "bad.json").write_text("{not json")
        registry.load_grown(spark, str(tmp_path / "bad.json")).collect()


def test_literal_rubric(spark, small):
    from tests.helpers import duck, same
    from tracewright.plans import fixtures

    items = rubric.parse(fixtures.RUBRIC_TEXT).frame(spark)
    con = duck(small)
    same(items.select("ord", "key", "title", "desc", "kind", "weight").toPandas(), con.execute("""SELECT ord::INT AS ord, key, title, "desc", kind, 1.0::DOUBLE AS weight FROM (VALUES (0, 'open_plainly', 'Open plainly.', 'No hook of any kind.', 'backbone'), (1, 'one_thesis', 'One thesis.', 'Carry it.', 'backbone'),
(2, 'no_em_dash', 'No em dash.', 'Not one.', 'mechanical'), (3, 'no_list', 'No list.', 'No list.', 'mechanical')) v(ord, key, title, "desc", kind)""").df())
    same(rubric.prompt_text(items).toPandas(), con.execute("""SELECT 'THE RUBRIC (keep every item):' || chr(10) || '- Open plainly. No hook of any kind.' || chr(10) || '- One thesis. Carry it.' || chr(10) || '- No em dash. Not one.' || chr(10) || '- No list. No list.' AS text""").df())
    assert rubric.total_weight(items).first()[0] == 4.0
    keys = spark.createDataFrame([(1, "one_thesis"), (2, "no_list"), (3, "unheard_of")], "n long, key string")
    same(rubric.described(keys, items).select("n", "key", "desc").toPandas(), con.execute("""SELECT n::BIGINT AS n, key, "desc" FROM (VALUES (1, 'one_thesis', 'Carry it.'), (2, 'no_list', 'No list.'), (3, 'unheard_of', 'unheard_of')) v(n, key, "desc")""").df())
    table = spark.createDataFrame([("a", fixtures.RUBRIC_TEXT), ("b", fixtures.RUBRIC_TEXT)], "rubric_id string, text string")
    assert rubric.items_of(table).where("rubric_id = 'b'").drop("rubric_id").exceptAll(items).count() == 0 and rubric.items_of(table).count() == 2 * items.count()


def test_prompts_carry_what_the_reference_asks_with(spark):
    from tracewright.plans import prompts

    rubric_items = [{"key": "open", "kind": "backbone", "desc": "Open plainly.", "weight": 1.0}, {"key": "list", "weight": 2.0}]
    seen = []

    class Asked(loop.StubEngine):
        def complete(self, system, prompt):
            seen.append((system, prompt))
            if system == "critique" and len(seen) == 2:
                return "no json"
            return super().complete(system, seen[1][1] if len(seen) == 3 else prompt)

    run = loop.run_loop("boats", Asked(), rubric_items, loop.LoopConfig(max_iter=2), context="they sailed in May", examples="--- sample ---\nA text.")
    assert [s for s, _ in seen] == ["generate", "critique", "critique", "repair", "critique"] and run.accepted
    write, judge, again, repair, _ = (p for _, p in seen)
    assert write.startswith("boats\n") and "- open [backbone]: Open plainly." in write and "A text." in write and "they sailed in May" in write
    assert prompts.parts(judge) == ("open,list", "Draft about boats [em_dash] [list]") and "- list [rule]: list" in judge and "A text." in judge and '"items"' in judge
    assert prompts.parts(again) == ("open,list", "no json")
    assert prompts.parts(repair)[0] == "list" and "- list: " in repair and "A text." in repair and repair.endswith("[list]")
    assert run.rounds[0]["items"][1] == {"key": "list", "pass": False, "weight": 2.0, "note": ""}


def test_result_records(spark):
    from tracewright.plans import prompts

    assert prompts.record_json({"a": 0.123456, "b": [0.5, {"c": 1 / 3}], "ş": None}) == '{"a": 0.1235, "b": [0.5, {"c": 0.3333}], "ş": null}'
    row = spark.range(1).select(prompts.result_json({"x": F.lit(1 / 3), "y": F.lit(None).cast("string"), "z": F.lit("é")}, ("x",)).alias("r")).first()
    assert row.r == '{"x":0.3333,"y":null,"z":"é"}'
