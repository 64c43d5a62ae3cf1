"""Chat windows, embeddings, quality, toxicity, HTML and the pipeline, with their edge cases."""

import hashlib
import html as references
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import duck, same
from tracewright.llm import chat, embeddings, html, oracles, queries, quality, simhash, toxicity

TALK = "conv_id long, turn long, role string, text string"


def test_chat_query(spark, small):
    got = queries.op3_chat(spark, small).toPandas()
    same(got, duck(small).execute(oracles.CHAT).df())
    row = got[got.conv_id == -7].iloc[0]
    text = r"\### Assistant: </turn> ok"
    assert row.n_turns == 2 and row.loss_chars == len(text) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def talk(spark):
    hard = ["", None, "\\", "####", "a\\/b</turn></turn>", "### x:\n</turn>\n", "\\\\#\\#", "x" * 3000, "é😀" * 40]
    rows = [(1, k, ["system", "user", "assistant"][k % 3] if k else "system", hard[k % len(hard)]) for k in range(60)]
    rows += [(2, None, None, "no turn"), (2, None, None, "no turn"), (2, 0, "assistant", "w " * 700), (2, 0, "assistant", "tie"), (None, 1, "a:b\\", "null conversation")]
    rows += [(3, k, "user" if k % 2 else "assistant", "word " * (k % 40)) for k in range(300)]
    return rows, spark.createDataFrame(rows, TALK)


def test_chat_windows(spark):
    rows, table = talk(spark)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(r)
    want = {c: [(r[2] or "", r[3] or "") for r in sorted(v, key=key)] for c, v in want.items()}
    for t in (table, table.select("*", *[F.lit(1).alias(c) for c in ("conv", "ord", "window", "tok", "sys", "kind")])):
        out = chat.windows(t, budget=256, history=64)
        read = out.withColumn("turns", chat.parse_turns(F.col("formatted"))).orderBy("conv", "window").collect()
        seen, learnt = {}, {}
        for w in read:
            turns = [(x["role"], x["text"]) for x in w["turns"]]
            own = turns[w["n_context"] :]
            seen.setdefault(w["conv"], []).extend(own)
            first = next((x for x in want[w["conv"]] if x[0] == "system"), None)
            assert first is None or first in turns  # the system turn is always there
            if w["tokens"] > 256:  # only where the system turn and one own turn do
                assert own == turns[-1:] and turns[:-1] in ([], [first])
            for s in w["loss"]:
                learnt.setdefault(w["conv"], []).append(w["formatted"][s["from"] : s["to"]])
        assert seen == want
        said = {c: [t for r, t in v if r == "assistant"] for c, v in want.items()}
        plain = {c: [re.sub(r"\\([\\/#:])", r"\1", x) for x in learnt.get(c, [])] for c in want}
        assert plain == said
        assert any(w["n_context"] for w in read)
    assert chat.windows(spark.createDataFrame([], TALK)).count() == 0


@pytest.mark.parametrize("budget,history", [(64, 16), (100, 90), (300, 40), (1024, 128)])
def test_chat_budget(spark, budget, history):
    """Random turns and system turns of any size: history gives way, then nothing but one own turn is left."""
    rng, rows = np.random.default_rng(budget), []
    for c in range(60):
        long = int(rng.choice([1, 20, budget // 3, budget - 60, budget - 10, 2 * budget]))
        at = int(rng.integers(0, 8)) if c % 5 else -1  # without a system turn
        for k in range(int(rng.integers(1, 40))):
            size = max(0, long) if k == at else int(rng.choice([0, 3, 15, budget // 4, budget // 2, budget - 20]))
            rows.append((c, k, "system" if k == at else "user" if k % 2 else "assistant", " ".join(f"w{c}x{k}" for _ in range(size))))
    system = {r[0]: (r[3], len(r[3].split()) + chat.MARKS) for r in rows if r[2] == "system"}
    repeated = 0
    for w in chat.windows(spark.createDataFrame(rows, TALK), budget=budget, history=history).withColumn("turns", chat.parse_turns(F.col("formatted"))).collect():
        turns = [(x["role"], x["text"]) for x in w["turns"]]
        sizes = [len(t.split()) + chat.MARKS for _, t in turns]
        assert sum(sizes) == w["tokens"]
        n = w["n_context"]
        headed = bool(n) and turns[0][0] == "system"
        repeated += n - headed
        assert sum(sizes[headed:n]) <= history and all(r != "system" for r, _ in turns[headed:n])
        if sum(sizes) > budget:
            assert n == headed and len(turns) - n == 1
        if w["conv"] in system:
            assert ("system", system[w["conv"]][0]) in turns
    assert repeated > 20


def vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((120, 12))
    rows = [(k, base[k].tolist(), k % 3) for k in range(120)]
    for k in range(200):
        a = base[rng.integers(0, 6)]
        rows.append((200 + k, (a + rng.standard_normal(12) * rng.choice([0.0, 0.05, 0.15])).tolist(), int(rng.integers(0, 3))))
    rows += [(500, None, 0), (501, [0.0] * 12, 0), (502, [1.0, None] * 6, 0), (503, [float("nan")] * 12, 0), (504, base[0].tolist(), None), (505, [], 1), (506, base[0][:5].tolist(), 0), (507, (3 * base[0]).tolist(), 0)]
    rows += [(None, base[1].tolist(), 1), (0, base[0].tolist(), 0), (508, [float("inf")] * 12, 1), (509, [2.0], 0), (510, [3.0], 0)]
    return rows


def brute_links(rows, threshold=0.98):
    n = len(rows)
    v = [None if x is None or any(c is None or not np.isfinite(c) for c in x) or not any(x) else np.array(x) for _, x, _ in rows]
    pairs = []
    for i in range(n):
        for j in range(i + 1, n):
            if v[i] is not None and v[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and v[i].size == v[j].size:
                if v[i] @ v[j] / np.sqrt(v[i] @ v[i]) / np.sqrt(v[j] @ v[j]) >= threshold:
                    pairs.append((i, j))
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * n
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
        up[root(i)] = root(j)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[root(i)] = min(low.get(root(i), rows[i][0]), rows[i][0])
    return Counter((rows[i][0], links[i], low.get(root(i)), rows[i][0] == low.get(root(i))) for i in range(n))


@pytest.mark.parametrize("tile", [2048, 7])
def test_embeddings_brute(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rows = vectors(spark)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embeddings.near_duplicates(table.withColumn("v", F.lit(1)).withColumn("node", F.lit("x"))).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == brute_links(rows)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_embeddings_query(spark, small):
    same(queries.op5_embeddings(spark, small).toPandas(), duck(small).execute(oracles.EMBEDDINGS).df())


def test_bounds_lose_nothing():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 40)) * np.linspace(3, 0.1, 40)
    x = np.concatenate([x, x[:100] + 0.1 * rng.standard_normal((100, 40))])
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    got = {(int(i), int(j)) for a, b in embeddings.linked_pairs(x, x, axes, 0.95, True) for i, j in zip(a, b)}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    assert got == set(zip(i.tolist(), j.tolist())) and len(got) > 90


# ---------------------------------------------------------------- quality and toxicity


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_quality(spark, sf).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(got.doc_id, got.held_out))
    marks = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    m = got[got.held_out].merge(marks, on="doc_id")
    assert m.predicted[m.quality == 1].mean() > 0.97 and m.predicted[m.quality == 0].mean() < 0.3
    # held-out labels can't matter
    spoilt = spark.createDataFrame(marks).withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    again = quality.score(docs.select("doc_id", "text"), quality.train(docs, spoilt, where=~quality.held_out("doc_id"))).toPandas()
    assert np.allclose(again.sort_values("doc_id").score, got.sort_values("doc_id").score)


def test_long_documents_take_part_in_the_fit(spark, monkeypatch):
    """The only bad documents are long ones: a window of their lines is enough to know them."""
    good = "A plain line of words that says something.\n" * 6
    bad = "BUY NOW!!! $$$ 999 | 999 | 999 !!!\n" * 5000
    docs = spark.createDataFrame([(k, bad if k % 5 == 0 else good + f"And line {k}.") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(60)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "TRAIN_LINES", 60 * 40)
    got = quality.score(docs, quality.train(docs, labels, most=60)).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 5 > 0) for r in got)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    field = quality.LineField(rng.standard_normal((20, 2)))
    field.step = rng.standard_normal((2, 2))
    counts, score = np.array([4, 1, 6]), rng.standard_normal(11)
    good, pairs = field.marginals(score, counts)
    want, want_pairs, at = [], np.zeros((2, 2)), 0
    for n in counts:
        p, total = np.zeros(n), 0.0
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(score[at + k] * y[k] for k in range(n)) + sum(field.step[y[k], y[k + 1]] for k in range(n - 1)))
            p += w * np.array(y)
            total += w
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(score[at + k] * y[k] for k in range(n)) + sum(field.step[y[k], y[k + 1]] for k in range(n - 1)))
            for k in range(n - 1):
                want_pairs[y[k], y[k + 1]] += w / total
        want += (p / total).tolist()
        at += n
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op2_toxicity(spark, sf).toPandas()
    m = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert len(got) == 1000 and m.predicted[m.toxic == 1].mean() > 0.85 and m.predicted[m.toxic == 0].mean() < 0.01


def test_toxicity_learns_unseen_forms_and_is_not_diluted(spark):
    rows, marks = [], []
    for k in range(400):
        bad = k % 5 == 0
        rows.append((k, "plain words about nothing " * (k % 7 + 1) + (f"grumblo{k % 3} and more" if bad else "")))
        marks.append((k, 1, int(bad)))
    rows += [(1000, "plain words " * 20_000 + "grumbloxyz"), (1001, "plain words " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert got[1000] == 1 and got[1001] == 0
    assert all(got[d] == t for d, _, t in marks)


def test_out_of_fold_features_never_see_their_fold(spark):
    """With the labels of a fold turned over, its own earlier probabilities stay; those of other folds change."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(toxicity.FOLDS))
    ids, before = toxicity.train(docs, labels).inside
    folds = {r[0]: r[1] for r in labels.select("doc_id", fold).collect()}
    at = np.array([folds[d] for d in ids])
    for f in range(2):
        turned = labels.withColumn("toxic", F.when(fold == f, 1 - F.col("toxic")).otherwise(F.col("toxic")))
        again, after = toxicity.train(docs, turned).inside
        assert (again == ids).all() and np.allclose(before[at == f, 0], after[at == f, 0], atol=1e-12)
        assert not np.allclose(before[at != f, 0], after[at != f, 0], atol=1e-3)


def test_chain_beats_models_of_their_own(spark):
    """`b` needs `a` and one more word. Few documents have b, so that most words of a are never seen with it."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(1800):
        bad, more = rng.random() < 0.4, rng.random() < 0.06
        said = [f"plain{rng.integers(40)}x" for _ in range(8)]
        said += [f"q{rng.integers(60)}zz" for _ in range(bad)] + ["very"] * more
        rows.append((k, " ".join(said), int(bad), int(bad and more)))
    rows += [(5000 + k, f"plain1x q{k}zz" + " very" * (k % 2), 1, k % 2) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, a int, b int")
    docs, marks = table.select("doc_id", "text"), table.where("doc_id < 5000").select("doc_id", "a", "b")

    def loss(model):
        got = toxicity.score(docs.where("doc_id >= 5000"), model).toPandas().merge(table.select("doc_id", "b").toPandas(), on="doc_id")
        p = np.clip(got.toxicity, 1e-6, 1 - 1e-6)
        return -np.where(got.b == 1, np.log(p), np.log(1 - p)).mean()

    chain = toxicity.train(docs, marks, label_cols=("a", "b"))
    assert chain.names == ["a", "b"] and chain.models[1].b[1] > 0.5  # b leans on a
    alone = toxicity.train(docs, marks, label_cols=("b", "b"))
    assert loss(chain) < 0.8 * loss(alone)


def test_logistic_model_by_newton(monkeypatch):
    monkeypatch.setattr(toxicity, "ROUNDS", 4000)
    monkeypatch.setattr(toxicity, "RATE", 0.01)
    monkeypatch.setattr(toxicity, "RIDGE", 0.1)
    rng = np.random.default_rng(0)
    on = rng.random((300, 5)) < 0.3
    dense = rng.standard_normal((300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(on @ [1, -1, 2, 0, 0.5] + dense[:, 0] - 0.5)))).astype(int)
    row, col = np.nonzero(on)
    got = toxicity.Linear().fit(row, col, 5, dense, y).predict(row, col, dense)
    x = np.concatenate([on, dense, np.ones((300, 1))], axis=1).astype(float)
    ridge, w = np.diag([0.01] * 7 + [0.0]), np.zeros(8)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / 300 + ridge, x.T @ (y - p) / 300 - ridge @ w)
    assert np.allclose(got, 1 / (1 + np.exp(-x @ w)), atol=5e-3)


def test_classifier_edges(spark, odd, odd_rows, empty, wide):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    few = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 0, 1), (4, None, 0), (5, 0, 1), (6, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, few):
        for table in (odd, wide):
            q = quality.score(table, quality.train(table, labels))
            t = toxicity.score(table, toxicity.train(table, labels))
            assert q.count() == t.count() == len(odd_rows)
            assert q.where("score between 0 and 1").count() == len(odd_rows) == t.where("toxicity between 0 and 1").count()
        assert quality.score(empty, quality.train(empty, labels)).count() == 0
        assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    assert quality.train(odd, none) == 0.5 and toxicity.train(odd, none) == 0.0


def test_training_rows_that_repeat(spark, small):
    """Copies of a labelled row and rows that share a labelled id don't change what is learned from the others."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    many = docs.unionByName(docs.where("doc_id < 50")).unionByName(docs.where("doc_id < 50"))
    a, b = (quality.score(docs, quality.train(t, labels)).orderBy("doc_id").toPandas() for t in (docs, many))
    assert np.allclose(a.score, b.score)
    few = quality.train(docs, labels, most_lines=200)
    assert quality.score(docs, few).count() == docs.count()
    pages = spark.read.parquet(f"{small}/pages.parquet")
    huge = spark.createDataFrame([(10**6 + k, "u", "<article>" + "x " * (html.TRAIN_CHARS // 2) + "</article>") for k in range(1)], "page_id long, url string, html string")
    model = html.train(pages.limit(20).unionByName(huge))
    assert model.weight.size > 100


# ---------------------------------------------------------------- HTML


@pytest.fixture(scope="module")
def model(spark, small):
    return html.train(spark.read.parquet(f"{small}/pages.parquet"))


def plain(page):
    a = page.index("<article>") + 9
    e = page.find("</article>", a)
    parts = re.split(r"</?(?:p|h1|div)\b[^>]*>|</?[a-z0-9]*\Z", page[a : len(page) if e < 0 else e])
    parts = [" ".join(references.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n".join(p for p in parts if p)


def test_html_query(spark, small):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = queries.op10_html(spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == plain(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_html_unseen_layouts(model):
    right = total = 0
    for source, marks in html.layouts(99, 150):
        page = html.Page(source)
        f = model.forest([page])
        p, _ = model.marginals(f, model.score(f))
        for node, text in page.blocks:
            right += (text.split(" ", 1)[0] in marks) == (p[node] >= 0.5)
            total += 1
    assert right / total > 0.97


SAID = "The committee met on Tuesday to discuss the plan, and after some hours the members agreed on a first draft of it."
#: Written by hand: (body, main text), with names and shapes that the generator doesn't make.
BY_HAND = [
    (f"<article><h1>T</h1><p>{SAID} where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>", f"T\n{SAID} where x=2 holds."),
    (f"<article><h1>T</h1><p>{SAID}</p><section class='related-work'><h2>Related work</h2><p>{SAID}</p></section></article>", f"T\n{SAID}\nRelated work\n{SAID}"),
    (f"<article><h1>T</h1><p>{SAID}</p><div class='share-price'><p>{SAID} Shares fell.</p></div></article>", f"T\n{SAID}\n{SAID} Shares fell."),
    (f"<article><h1>T</h1><p>{SAID}</p><div class='kommentare'><p>I do not agree with this at all, sorry.</p></div></article>", f"T\n{SAID}"),
    (f"<article><h1>T</h1><p>{SAID}</p><div class='share-buttons'><a href='x'>Share</a> <a href='y'>Tweet</a></div></article>", f"T\n{SAID}"),
    (f"<div class='xq'><div class='zz9'><h1>T</h1>{f'<p>{SAID}</p>' * 6}</div><div class='ww'><a href='1'>Home</a><a href='2'>News</a></div></div>", "T" + f"\n{SAID}" * 6),
    (f"<main><article><h1>T</h1><p>{SAID}</p><section><article class='c'><p>Nice text, thank you.</p></article><article class='c'><p>Agreed.</p></article></section></article></main>", f"T\n{SAID}"),
    (f"<article><p>{SAID}</p><noscript><p>{SAID}</p></noscript><object data='x'><p>{SAID}</p></object><svg><text>Figure label</text></svg><script>no()</script></article>", f"{SAID}\n{SAID}\n{SAID}\nFigure label"),
    (f"<table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td id=c2><h2>T</h2>{f'<p>{SAID}' * 4}</td></tr></table>", "T" + f"\n{SAID}" * 4),
]


#: What an article may hold, and what it may hold that isn't its text: (markup, its text or None).
WITHIN = [
    ("<p><a href='/r'>The full report of the committee can be read here</a></p>", "The full report of the committee can be read here"),
    ("<ul><li><a href='/a'>First chapter of the report</a></li><li><a href='/b'>Second chapter of the report</a></li></ul>", "First chapter of the report\nSecond chapter of the report"),
    ("<xmp><b>bold</b> &amp; plain</xmp>", "<b>bold</b> &amp; plain"),
    (f"<div class='callout'>{SAID}</div>", SAID),
    (f"<div class='callout'><p>{SAID}</p></div>", SAID),
    (f"<div class='note'><p>{SAID}</p></div>", SAID),
    (f"<div class='banner-year'><p>{SAID} {SAID}</p></div>", f"{SAID} {SAID}"),
    (f"<section class='social-history'><h2>History</h2><p>{SAID}</p></section>", f"History\n{SAID}"),
    (f"<section class='search-results-study'><p>{SAID}</p></section>", SAID),
    ("<dl><dt>Term</dt><dd>What the term means in this text</dd></dl>", "Term\nWhat the term means in this text"),
    ("<aside><p>Subscribe to our newsletter and never miss a story again, it is free and comes every week.</p></aside>", None),
    ("<aside class='author-box'><p>Jane Doe has written about committees for twenty years and lives in the north with two cats.</p></aside>", None),
    ("<form><p>Tell us what you think about the work of the committee and win one of our prizes this week.</p><input></form>", None),
    ("<header>The Daily Committee</header>", None),
]


@pytest.mark.parametrize("k", range(len(WITHIN)))
@pytest.mark.parametrize("around", ["<article>{}</article>", "<div class='content'>{}</div>", "<div class='zq'>{}</div>"])
def test_html_within(model, around, k):
    markup, text = WITHIN[k]
    body = around.format(f"<h1>T</h1><p>{SAID}</p><p>{SAID}</p>{markup}<p>{SAID}</p>")
    page = f"<html><head><title>x</title></head><body><nav><a href='/'>Home</a> <a href='/n'>News</a></nav>{body}<footer>(c) 2020</footer></body></html>"
    assert model.extract([page])[0].split("\n") == ["T", SAID, SAID, *([] if text is None else text.split("\n")), SAID]


def test_html_form_around_a_page(model):
    page = f"<body><form action='/x'><nav><a href='/'>Home</a></nav><article><h1>T</h1><p>{SAID}</p></article></form></body>"
    assert model.extract([page])[0] == f"T\n{SAID}"


@pytest.mark.parametrize("k", range(len(BY_HAND)))
def test_html_by_hand(model, k):
    body, want = BY_HAND[k]
    page = f"<html><head><title>x</title></head><body><nav><a href='/'>Home</a></nav>{body}<footer>(c) 2020</footer></body></html>"
    assert model.extract([page])[0] == want


@pytest.mark.parametrize("make", [lambda n: "<div>" * n, lambda n: "<span>" * n + "</p>" * n, lambda n: "<span></p>" * n, lambda n: "<p><b>" * n, lambda n: "<li><i>" * n, lambda n: "<table><tr><td>" * n])
def test_html_reads_in_linear_time(make):
    began = time.process_time()
    page = html.Page("<article><p>begin</p>" + make(100_000) + "end")
    assert time.process_time() - began < 8 and max(page.depth) <= html.DEEPEST
    assert [t for _, t in page.blocks] == ["begin", "end"]


def test_html_parsing(model):
    body = "<p>Long enough text of the article, with &lt;tags&gt; &amp; more.<p>Second&nbsp; one <b>bold <i>both</b></i>\n here<br>after</p><ul><li>item one<li>item two</ul>"
    page = f"<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><div class='cookie-notice'>We use cookies.</div><header>Site</header><article>{body}<form><p>Send</p></form><script>var x='<p>no</p>'</script><!-- <p>no --></article><aside class=sidebar>Also read</aside><div id='comments'><p>First comment by a reader of this page</p></div><footer>(c)</footer>"
    want = "Long enough text of the article, with <tags> & more.\nSecond one bold both here after\nitem one\nitem two"
    assert model.extract([page, "", "no markup at all", "<p", "<script>x"])[0] == want


def test_tree_messages_by_enumeration():
    rng = np.random.default_rng(1)
    page = html.Page("<div><p>a<p>b<div><p>c</div></div><section>d</section>")
    m = html.TreeModel([])
    m.edge = rng.standard_normal((2, 2))
    f = m.forest([page])
    n = len(page.tag)
    score = rng.standard_normal(n)
    p, pairs = m.marginals(f, score)
    want, total, want_pairs = np.zeros(n), 0.0, np.zeros((2, 2))
    for code in range(2**n):
        y = [(code >> k) & 1 for k in range(n)]
        w = np.exp(sum(score[k] * y[k] for k in range(n)) + sum(m.edge[y[page.parent[k]], y[k]] for k in range(1, n)))
        want += w * np.array(y)
        total += w
        for k in range(1, n):
            want_pairs[y[page.parent[k]], y[k]] += w
    assert np.allclose(p, want / total) and np.allclose(pairs, want_pairs / total)


def test_html_edges(spark, small, model):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", ""), (None, None, "<article><p>some text"), (2, "v", "<div>" * 3000 + "deep"), (2, "v", "&am <p")], "page_id long, url string, html string")
    for table in (pages, pages.withColumn("text", F.lit("x")).withColumn("n_chars", F.lit("y"))):
        got = html.extract(table, html.train(table)).collect()
        assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
        assert {r["text"] for r in got if r["page_id"] is None} == {"some text"}
    assert html.extract(pages.limit(0), html.train(pages.limit(0))).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, small):
    import sentencepiece

    import corpus_pipeline as c
    from tests.llm.test_text_operators import brute_simhash
    from tracewright.llm import pieces

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    docs = spark.read.parquet(f"{small}/documents.parquet")
    marks = spark.read.parquet(f"{small}/labels.parquet")
    a = c.quality_stage(spark, docs, small).cache()
    scores = queries.op4_quality(spark, small).where("predicted = 1").select("doc_id")
    assert a.columns == docs.columns and {r[0] for r in scores.collect()} == {r["doc_id"] for r in a.collect()}
    b = c.toxicity_stage(spark, a, small).cache()
    kept = toxicity.score(a.select("doc_id", "text"), toxicity.train(a, marks)).where("predicted = 0")
    assert {r["doc_id"] for r in b.collect()} == {r["doc_id"] for r in kept.collect()} and b.count() < a.count()
    d = c.simhash_stage(spark, b, small).cache()
    want = brute_simhash([(r["doc_id"], r["text"]) for r in b.collect()])
    assert {r["doc_id"] for r in d.collect()} == {x[2] for x in want} and d.count() == len({x[2] for x in want})
    e = c.mixing_stage(spark, d, small).cache()
    con = duck(small)
    con.execute("DROP VIEW documents")
    con.register("documents", d.toPandas())
    mix = con.execute(oracles.MIXING).df()
    sizes = dict(zip(mix.doc_id, mix["size"]))
    times = Counter(r["doc_id"] for r in e.collect())
    assert {k: n * sizes[k] for k, n in times.items()} == {k: t for k, t in zip(mix.doc_id, mix.taken) if t}
    f = c.run(spark, small).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert Counter(r["doc_id"] for r in f) == times
    assert all(r["ids"] == lib.encode(texts[r["doc_id"]]) and r["decoded_ok"] for r in f)


def test_pipeline_edges(spark, odd, empty, wide, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([(1, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (odd, wide, empty):
        rows = table
        for name, stage in c.STAGES:
            rows = stage(spark, rows, str(tmp_path))
            if name != "pieces":
                assert rows.columns == table.columns
        rows.collect()
    assert simhash.one_of_each(odd).where("doc_id is null").count() >= 1
