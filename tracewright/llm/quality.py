"""Document quality from a linear-chain conditional random field over lines.

Every line has features of its own (case, symbols, repetition, ...), cut into bins, and those of its
neighbours. The field labels each line good or bad; its forward-backward marginals, weighted by
the lines' lengths, make the share of good text, and a logistic curve over that share gives the
score. Labels exist for documents only: a first model without transitions takes each line for
what its document is, then lines of bad documents that it finds good are taken for good, and the field is
trained with these line labels.

The fit uses a bounded sample of labelled documents (TRAIN_DOCS) and of their lines: a document with more than
TRAIN_LINES / TRAIN_DOCS of them takes part with that many consecutive ones, from a place that follows from
a hash of its text. Every document is scored over its whole text; null and empty texts are one empty
line, equal texts get equal scores, repeated rows their row each. Repeated labels of a document count as
their greatest, null ones don't. Without labels of both classes each score is the share of label 1
(0.5 if there are no labels). Columns named score or predicted give way. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_text

TRAIN_DOCS, TRAIN_LINES = 6000, 1_800_000
ACCEPT = 0.7
BINS, ROUNDS, RATE, RIDGE = 8, 120, 0.15, 1e-4
#: Lines of a bad document that the first model gives at least this are taken for good.
GOOD_LINE = 0.9
#: Word characters and separators by byte: bytes from 128 on belong to letters.
_KINDS = 8


def _byte_kinds() -> np.ndarray:
    """0 other symbol, 1 lower-case or non-ASCII letter, 2 upper-case, 3 digit, 4 space, 5 sentence mark, 6 '!', 7 '|'."""
    kind = np.zeros(256, np.int64)
    kind[ord("a") : ord("z") + 1] = 1
    kind[128:] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    kind[[9, 10, 11, 12, 13, 32]] = 4
    kind[[ord(c) for c in ".,;:?'\"-()"]] = 5
    kind[ord("!")] = 6
    kind[ord("|")] = 7
    return kind


BYTE_KIND = _byte_kinds()
N_FEATURES = 13


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length of each line, number of lines of each text)."""
    lines: list[str] = []
    counts = []
    word = []
    for t in texts:
        own = t.split("\n")
        counts.append(len(own))
        lines += own
        seen: set[str] = set()
        for line in own:
            words = line.split()
            n, m = len(words), len(set(words))
            word.append((n, m, line in seen))
            seen.add(line)
    raw = "\n".join(lines).encode() + b"\n"
    data = np.frombuffer(raw, np.uint8)
    ends = np.cumsum([len(x.encode()) + 1 for x in lines]) if not raw.isascii() else np.flatnonzero(data == 10)[: len(lines)] + 1
    starts = np.concatenate([[0], ends[:-1]])
    kind = BYTE_KIND[data]
    by = np.stack([np.add.reduceat((kind == k).astype(np.int32), starts) for k in range(_KINDS)], axis=1).astype(float)
    by[:, 4] -= 1  # the line's end
    size = np.maximum(by.sum(axis=1), 1)
    letters = np.maximum(by[:, 1] + by[:, 2], 1)
    n, m, again = np.array(word, float).reshape(-1, 3).T
    x = np.stack(
        [
            np.log1p(by.sum(axis=1)),
            by[:, 2] / letters,
            by[:, 3] / size,
            by[:, 0] / size,
            by[:, 5] / size,
            by[:, 6] / size,
            by[:, 7] / size,
            (by[:, 1] + by[:, 2]) / size,
            size / np.maximum(n, 1),
            np.log(np.maximum(n, 1) / np.maximum(m, 1)),
            np.log1p(n),
            again,
            n == 0,
        ],
        axis=1,
    )
    return x, by.sum(axis=1), np.array(counts, np.int64)


class LineField:
    """Bins, weights and transitions of the field, and the curve that turns shares into scores."""

    def __init__(self, x: np.ndarray):
        self.cuts = [self._cuts(x[:, k]) for k in range(x.shape[1])]
        self.slots = 4 * BINS
        self.weight = np.zeros(3 * x.shape[1] * self.slots + 1)
        self.step = np.zeros((2, 2))
        self.curve = np.array([0.0, 1.0])

    @staticmethod
    def _cuts(x: np.ndarray) -> np.ndarray:
        """Quantiles of all values and of those above the least: most lines have none of most marks."""
        inner = np.linspace(0, 1, BINS + 1)[1:-1]
        above = x[x > x.min()]
        return np.unique(np.concatenate([np.quantile(x, inner), np.quantile(above, inner)] if above.size else [x[:1]]))

    def cells(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weight indices of each line: its own bins and those of the lines before and after."""
        own = np.stack([np.searchsorted(c, x[:, k], "left") + np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)], axis=1)
        own = np.minimum(own, self.slots - 2)
        last = np.cumsum(counts)
        before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
        before[last[:-1]], before[:1] = self.slots - 1, self.slots - 1
        after[last - 1] = self.slots - 1
        every = np.concatenate([own, before, after], axis=1)
        return every + np.arange(every.shape[1]) * self.slots

    def node(self, cells: np.ndarray) -> np.ndarray:
        return self.weight[cells].sum(axis=1) + self.weight[-1]

    def marginals(self, score: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the expected transitions; all documents step by step at once."""
        order = np.argsort(-counts, kind="stable")
        first = (np.cumsum(counts) - counts)[order]
        n = counts[order]
        ahead, back = np.zeros((score.size, 2)), np.zeros((score.size, 2))
        live = np.searchsorted(-n, -np.arange(1, (n[0] if n.size else 0) + 1), "right")
        node = np.stack([np.zeros_like(score), score], axis=1)
        for t, k in enumerate(live):
            at = first[:k] + t
            ahead[at] = node[at] if not t else node[at] + np.logaddexp(ahead[at - 1, :1] + self.step[0], ahead[at - 1, 1:] + self.step[1])
        for t in range(live.size - 2, -1, -1):
            at = first[: live[t + 1]] + t
            nxt = node[at + 1] + back[at + 1]
            back[at] = np.logaddexp(self.step[:, 0] + nxt[:, :1], self.step[:, 1] + nxt[:, 1:])
        both = ahead + back
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
        total = np.logaddexp(both[:, 0], both[:, 1])
        inner = np.ones(score.size, bool)
        inner[np.cumsum(counts) - counts] = False
        at = np.flatnonzero(inner)
        p = ahead[at - 1][:, :, None] + self.step + (node[at] + back[at])[:, None, :] - total[at][:, None, None]
        return good, np.exp(p).sum(axis=0)

    def fit(self, cells: np.ndarray, counts: np.ndarray, y: np.ndarray, importance: np.ndarray, chain: bool) -> None:
        """Maximum conditional likelihood of the line labels by gradient steps of adapted length."""
        inner = np.ones(y.size, bool)
        inner[np.cumsum(counts) - counts] = False
        at = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at - 1], y[at]), 1)
        m, v = np.zeros(self.weight.size), np.zeros(self.weight.size)
        ms, vs = np.zeros((2, 2)), np.zeros((2, 2))
        for k in range(1, ROUNDS + 1):
            score = self.node(cells)
            if chain:
                good, went = self.marginals(score, counts)
            else:
                good = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
            off = (y - good) * importance
            g = np.bincount(cells.ravel(), np.repeat(off, cells.shape[1]), self.weight.size) / y.size - RIDGE * self.weight
            g[-1] += off.mean()
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.weight += RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            if chain and at.size:
                g = (seen - went) / at.size - RIDGE * 10 * self.step
                ms, vs = 0.9 * ms + 0.1 * g, 0.99 * vs + 0.01 * g * g
                self.step += RATE * (ms / (1 - 0.9**k)) / (np.sqrt(vs / (1 - 0.99**k)) + 1e-8)

    def shares(self, x: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Share of good text of each document, by length-weighted marginals."""
        good, _ = self.marginals(self.node(self.cells(x, counts)), counts)
        weight = length + 1.0
        starts = np.cumsum(counts) - counts
        return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * (self.shares(*line_features(texts)) - 0.5))))


def _curve(share: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic curve of the label over the share, classes weighing as they occur; rising."""
    a = np.zeros(2)
    z = np.stack([np.ones(share.size), share - 0.5], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ a))
        w = np.maximum(p * (1 - p), 1e-6)
        a += np.linalg.solve((z * w[:, None]).T @ z + np.diag([1e-3, 1e-2]), z.T @ (y - p) - np.array([1e-3, 1e-2]) * a)
    return a if a[1] > 0 else np.array([np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), 1e-6])


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", where: Column | None = None, most: int = TRAIN_DOCS, most_lines: int | None = None):
    """Fit on labelled documents; returns a LineField, or the prior where a class is missing.

    At most `most` documents take part, each with at most most_lines / most lines in a row (TRAIN_LINES: 300 of them). Without that a few very
    long documents would be nearly all of the lines, and the fit one to them. Of rows that share a labelled id the least text counts.
    """
    sample = labelled_sample(labels, id_col, label_col, most, where)
    docs = df.select(F.col(id_col).alias("own"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.join(sample, F.col("own") == F.col("id_")).groupBy("id_", "label").agg(F.min("text").alias("text"))
    room = max(1, (TRAIN_LINES if most_lines is None else most_lines) // most)

    def features(texts: list[str]) -> list[np.ndarray]:
        x, length, counts = line_features(texts)
        rows = np.concatenate([x, length[:, None]], axis=1).astype("<f4")
        out = []
        for t, begin, n in zip(texts, np.cumsum(counts) - counts, counts):
            begin += zlib.crc32(t.encode("utf-8", "surrogatepass")) % max(1, n - room + 1)
            out.append(rows[begin : begin + min(n, room)].tobytes())
        return [np.array(out, object)]

    got = map_text(docs, "text", features, "x binary").toPandas().sort_values(["id_", "label"], kind="stable")
    y = got["label"].to_numpy(int)
    if not y.size or y.min() == y.max():
        return float(y.mean()) if y.size else 0.5
    rows = [np.frombuffer(b, "<f4").reshape(-1, N_FEATURES + 1) for b in got["x"]]
    counts = np.array([r.shape[0] for r in rows])
    rows = np.concatenate(rows).astype(float)
    x, length = rows[:, :-1], rows[:, -1]
    field = LineField(x)
    cells = field.cells(x, counts)
    line_y = np.repeat(y, counts)
    # Bad documents are few: both classes of lines get half of the weight.
    share = np.clip(line_y.mean(), 0.02, 0.98)
    importance = np.where(line_y == 1, 0.5 / share, 0.5 / (1 - share))
    field.fit(cells, counts, line_y, importance, chain=False)
    first = 1 / (1 + np.exp(-np.clip(field.node(cells), -500, 500)))
    field.fit(cells, counts, np.where(first >= GOOD_LINE, 1, line_y), np.ones(line_y.size), chain=True)
    field.curve = _curve(field.shares(x, length, counts), y)
    return field


def score(df: DataFrame, model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """`df` with `score` double (0 to 1) and `predicted` int (1 from ACCEPT on), in place of columns of these names."""
    if isinstance(model, float):
        compute = lambda texts: [np.full(len(texts), model)]
    else:
        shared = df.sparkSession.sparkContext.broadcast(model)  # a few thousand weights
        compute = lambda texts: [shared.value.score(texts)]
    out = map_text(df, text_col, compute, "score double", keep_text)
    return out.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
