"""Toxicity by a classifier chain of linear models over indicator terms.

Terms are the words of a text and their beginnings of 4 to 6 characters, so that inflected forms count.
From a bounded sample of labelled documents (TRAIN_DOCS) the terms that mark a category are selected by
their document frequencies. The chain predicts one category after the other with logistic models
over the presence of the selected terms, their number, and the probabilities of all earlier
categories. Later models are trained with out-of-fold predictions of the earlier ones: what predicts
a fold (terms, their number, weights) is chosen and fitted without that fold's labels. From the second
link on its training rows carry their own folds' out-of-fold probabilities, as is usual.

Several label columns make one category each, in their order. Where the labels name one category only, as
here, the chain has two links with inputs of their own: `explicit` (a toxic document with a
marked whole word) sees whole words, and `toxic`, whose probability is the score, sees beginnings, and the
whole words by way of the first link.

Whole texts are scored; presence doesn't dilute with length. Null and empty texts have no terms. Repeated
labels of a document count as their greatest, labels in which a category is null are not used. Without labels
of both classes in the last category each score is the share of its labels (0 without labels). Columns named like a
result give way to it. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_text

TRAIN_DOCS, FOLDS = 20000, 3
#: Most terms of a category, fewest of its documents that hold a term, least ratio of a term's rates in these and in other documents.
TERMS, SUPPORT, RATIO = 4096, 2, 12.0
#: Least log-likelihood ratio of a term, beyond twice the logarithm of the number of labelled documents: the more there are, the
#: more terms mark a category by chance.
SURE = -4.0
#: Terms that a task counts before it passes them on.
KEPT_TERMS = 400_000
REJECT = 0.2
BEGINNINGS = (4, 5, 6)
WORDS = re.compile(r"[^\W\d_]+")
ROUNDS, RATE, RIDGE = 300, 0.1, 1e-3


def words(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


def terms(word: str) -> list[str]:
    """The word, marked as whole, and its beginnings."""
    return [word + "$", *(word[:k] for k in BEGINNINGS if len(word) >= k)]


class Linear:
    """Logistic model over sparse presences and some dense columns."""

    def fit(self, row: np.ndarray, col: np.ndarray, width: int, dense: np.ndarray, y: np.ndarray) -> "Linear":
        n = y.size
        w, b = np.zeros(width), np.zeros(dense.shape[1] + 1)
        b[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        x = np.concatenate([dense, np.ones((n, 1))], axis=1)
        g1, v1, g2, v2 = np.zeros(width), np.zeros(width), np.zeros(b.size), np.zeros(b.size)
        for k in range(1, ROUNDS + 1):
            z = np.bincount(row, w[col], n) + x @ b
            off = y - 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            g = np.bincount(col, off[row], width) / n - RIDGE * w / 10
            h = x.T @ off / n - np.append(np.full(b.size - 1, RIDGE / 10), 0) * b
            for grad, m, v, at in ((g, g1, v1, w), (h, g2, v2, b)):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                at += RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.w, self.b = w, b
        return self

    def predict(self, row: np.ndarray, col: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = np.bincount(row, self.w[col], dense.shape[0]) + dense @ self.b[:-1] + self.b[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Chain:
    """Linear models in sequence; each sees its own terms and the probabilities of those before it."""

    def __init__(self, names: list[str], vocabulary: list[str], sees: np.ndarray):
        """sees: (terms, links) whether a link's model takes a term."""
        self.names, self.sees = names, sees
        self.number = {t: i for i, t in enumerate(vocabulary)}
        self.models: list[Linear] = []
        self.known: dict[str, tuple[int, ...]] = {}
        #: Ids and out-of-fold probabilities of the training rows.
        self.inside: tuple[np.ndarray, np.ndarray] | None = None

    def presences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, terms) of the terms present."""
        if len(self.known) > 500_000:
            self.known.clear()
        known, number = self.known, self.number
        row, col = [], []
        for i, t in enumerate(texts):
            mine: set[int] = set()
            for w in words(t):
                got = known.get(w)
                if got is None:
                    got = known[w] = tuple(number[x] for x in terms(w) if x in number)
                if got:
                    mine.update(got)
            row += [i] * len(mine)
            col += mine
        return np.array(row, np.int64), np.array(col, np.int64)

    def predict(self, texts: list[str]) -> list[np.ndarray]:
        row, col = self.presences(texts)
        out: list[np.ndarray] = []
        for k, m in enumerate(self.models):
            on = self.sees[col, k]
            out.append(m.predict(row[on], col[on], _dense(row[on], len(texts), out)))
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "inside": None}


def _dense(row: np.ndarray, n: int, earlier: list[np.ndarray]) -> np.ndarray:
    """log(1 + terms present), and the probabilities of the earlier categories."""
    return np.stack([np.log1p(np.bincount(row, minlength=n)), *earlier], axis=1)


def _sample(labels: DataFrame, id_col: str, label_cols: tuple[str, ...], most: int) -> DataFrame:
    """At most `most` labelled ids by hash, with y0, y1, ...: small enough to broadcast by that bound."""
    rows = labels.select(F.col(id_col).alias("id_"), *[(F.col(c) != 0).cast("int").alias(f"y{k}") for k, c in enumerate(label_cols)]).na.drop()
    rows = rows.groupBy("id_").agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(len(label_cols))])
    return F.broadcast(cut(rows.orderBy(F.xxhash64("id_"), "id_").limit(most)))


def _frequencies(docs: DataFrame, labels: int) -> DataFrame:
    """term, and for each fold f the documents that hold it: n{f}, and of label k: n{f}_{k}. Counted in the tasks before they are shuffled."""
    names = [f"n{f}{s}" for f in range(FOLDS) for s in ("", *(f"_{k}" for k in range(labels)))]
    width = labels + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            table = np.array(list(seen.values()), np.int64).reshape(-1, len(names))
            columns = [pa.array(list(seen), pa.string()), *(pa.array(table[:, k]) for k in range(len(names)))]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, ["term", *names])

        for batch in batches:
            for text, fold, *y in zip(*(batch.column(k).to_pylist() for k in range(width + 1))):
                at = [fold * width, *(fold * width + 1 + k for k in range(labels) if y[k])]
                for term in {x for w in words(text) for x in terms(w)}:
                    if term not in seen:
                        seen[term] = [0] * len(names)
                    mine = seen[term]
                    for k in at:
                        mine[k] += 1
                if len(seen) > KEPT_TERMS:
                    yield flush()
        yield flush()

    there = docs.select("text", "fold", *[f"y{k}" for k in range(labels)]).mapInArrow(count, "term string, " + ", ".join(f"{c} long" for c in names))
    return there.groupBy("term").agg(*[F.sum(c).alias(c) for c in names])


def _surprise(own: Column, every: Column, rate: float) -> Column:
    """Log-likelihood ratio of a term's share of the category against the category's rate."""

    def part(x: Column, p: float) -> Column:
        return F.when(x > 0, x * F.log(x / (every * F.lit(float(min(max(p, 1e-9), 1.0)))))).otherwise(0.0)

    return 2 * (part(own, rate) + part(every - own, 1 - rate))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_cols: tuple[str, ...] = ("toxic",), most: int = TRAIN_DOCS):
    """A Chain, or the share of the last category where it has one class only."""
    sample = _sample(labels, id_col, label_cols, most)
    docs = df.select(F.col(id_col).alias("own"), F.col(text_col).cast("string").alias("text"))
    docs = docs.join(sample, F.col("own") == F.col("id_"))
    ys = [f"y{k}" for k in range(len(label_cols))]
    docs = docs.select("id_", *ys, F.pmod(F.xxhash64("id_", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = docs.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys]).collect()
    n = np.zeros((FOLDS, len(ys) + 1))
    for r in sizes:
        n[r["fold"]] = [r["n"], *(r[y] for y in ys)]
    total, positive = n[:, 0].sum(), n[:, -1].sum()
    if not positive or positive == total:
        return positive / total if total else 0.0

    # Terms that mark a category, without each of the folds and over all of them.
    freq = _frequencies(docs, len(ys))
    marks = {}
    for k in range(len(ys)):
        for f in [*range(FOLDS), None]:
            others = [g for g in range(FOLDS) if g != f]
            own, every = sum(F.col(f"n{g}_{k}") for g in others), sum(F.col(f"n{g}") for g in others)
            of, rest = n[others, k + 1].sum(), (n[others, 0] - n[others, k + 1]).sum()
            marks[k, f] = (own >= SUPPORT) & (own / float(max(of, 1)) >= RATIO * (every - own + 0.5) / float(max(rest, 1))) & (_surprise(own, every, of / max(of + rest, 1)) >= SURE + 2 * float(np.log(max(of + rest, 1)))), own
    any_ = F.lit(False)
    for fits, _ in marks.values():
        any_ = any_ | fits
    freq = cut(freq.where(any_))
    top = {at: [r[0] for r in freq.where(fits).orderBy(F.desc(own), "term").limit(TERMS).select("term").collect()] for at, (fits, own) in marks.items()}
    vocabulary = sorted(set().union(*top.values()))
    chosen = {at: np.isin(vocabulary, found) if found else np.zeros(len(vocabulary), bool) for at, found in top.items()}
    whole = np.array([t.endswith("$") for t in vocabulary], bool)

    finder = Chain([], vocabulary, np.zeros((0, 0), bool))
    shared = df.sparkSession.sparkContext.broadcast(finder)  # at most TERMS strings a category and fold

    def found(texts: list[str]) -> list[np.ndarray]:
        row, col = shared.value.presences(texts)
        ends = np.searchsorted(row, np.arange(len(texts) + 1))
        lists = np.empty(len(texts), object)
        lists[:] = [col[a:b] for a, b in zip(ends[:-1], ends[1:])]
        return [lists]

    got = map_text(docs, "text", found, "terms array<bigint>").toPandas().sort_values("id_", kind="stable")
    fold, size = got["fold"].to_numpy(int), [len(t) for t in got["terms"]]
    row = np.repeat(np.arange(fold.size), size)
    col = np.concatenate([np.asarray(t, np.int64) for t in got["terms"]])
    # (name, number of the label, terms it may see, does a whole word have to be there?)
    if len(ys) > 1:
        links = [(c, k, np.ones(len(vocabulary), bool), False) for k, c in enumerate(label_cols)]
    else:
        links = [("explicit", 0, whole, True), (label_cols[0], 0, ~whole, False)]
    chain = Chain([x[0] for x in links], vocabulary, np.stack([chosen[k, None] & may for _, k, may, _ in links], axis=1))
    earlier: list[np.ndarray] = []
    for at, (_, k, may, named) in enumerate(links):
        y = got[f"y{k}"].to_numpy(int)
        inside = np.zeros(y.size)
        for f in range(FOLDS):
            fresh = fold == f
            if fresh.any() and not fresh.all():
                sees = (chosen[k, f] & may)[col]
                inside[fresh] = _link(row[sees], col[sees], len(vocabulary), earlier, y, named, ~fresh)[1][fresh]
        sees = chain.sees[col, at]
        model, _ = _link(row[sees], col[sees], len(vocabulary), earlier, y, named, np.ones(y.size, bool))
        chain.models.append(model)
        earlier.append(inside)
    chain.inside = got["id_"].to_numpy(), np.stack(earlier, axis=1)
    return chain


def _link(row: np.ndarray, col: np.ndarray, width: int, earlier: list[np.ndarray], y: np.ndarray, named: bool, on: np.ndarray) -> tuple[Linear, np.ndarray]:
    """A model of y fitted to the rows that are on, and its predictions for all; named: only rows with a term can be positive."""
    dense = _dense(row, y.size, earlier)
    y = y & (dense[:, 0] > 0) if named else y
    use = on[row]
    model = Linear().fit((np.cumsum(on) - 1)[row[use]], col[use], width, dense[on], y[on])
    return model, model.predict(row, col, dense)


def score(df: DataFrame, model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """`df` with p_<category> of the categories before the last, `toxicity` (the last one's probability) and `predicted`
    int (1: toxic), in place of columns of these names."""
    if isinstance(model, float):
        fields, compute = [], lambda texts: [np.full(len(texts), model)]
    else:
        shared = df.sparkSession.sparkContext.broadcast(model)  # a bounded number of terms and weights
        fields, compute = [f"`p_{x}` double" for x in model.names[:-1]], lambda texts: shared.value.predict(texts)
    out = map_text(df, text_col, compute, ", ".join([*fields, "toxicity double"]), keep_text)
    return out.withColumn("predicted", (F.col("toxicity") >= REJECT).cast("int"))
