"""Embedding whitening: an exact distributed scatter, cyclic Jacobi rotations on the driver, a broadcast projection.

Each entry c of a vector becomes the whole number floor(SCALE * c) + OFFSET. The fit list holds each distinct vector
once. Its scatter is taken about the whole-number mean of each dimension, block by block as products of 16-bit limbs,
which doubles multiply and add without rounding; what the mean has beyond a whole number is set right in integers. So the
covariance is exact before it is rounded once, in any order of the tasks. The driver then applies
symmetric rotations in cyclic (round-robin) order, in extended precision, until no off-diagonal entry is above rounding relative to its
diagonal; that leaves small eigenvalues accurate too. What reaches the driver is one symmetric matrix for each vector length.

Left out are vectors that are null, hold a null, NaN or infinite entry, or one of 2^56 and more in size (its scaled value is
no long). Vectors of different length are whitened apart from each other, empty ones have no components. Repeated
rows, and rows with a null id, each get their row. A component without variance (eigenvalue zero to working precision)
has a null projection; if there is no variance at all, explained and identity_error are null too. `deviation` is
null where it exceeds a long. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_length, cut, positional

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Entries from this size on are no longs once scaled.
MOST = float(1 << 56)
#: Bits of a limb; rows whose products of limbs add up below 2^53; numbers of a block.
LIMB, EXACT_ROWS, BLOCK = 16, 1 << 21, 1 << 20
#: Sweeps after which the rotations end in any case; they take ten or so.
SWEEPS = 60


@dataclass
class Whitening:
    """What is known of the vectors of one length."""

    n: int
    shift: np.ndarray  # whole-number means
    rest: list[int]  # sums about them
    eigenvalues: np.ndarray  # of the components, falling; zero where there is no variance
    axes: np.ndarray  # unit eigenvectors, one a column
    explained: np.ndarray | None
    small: bool  # do all deviations fit a long?
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.shift) - np.array([r / self.n for r in self.rest])

    def project(self, x: np.ndarray) -> np.ndarray:
        """(rows, components); NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (self.centred(x) @ self.axes) / np.where(self.eigenvalues > 0, np.sqrt(self.eigenvalues), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - sum)^2, exactly."""
        z = x - self.shift
        if self.small:
            return (((self.n * z - np.array(self.rest, np.int64)) ** 2).sum(axis=1)).tolist()
        sums = ((self.n * z.astype(object) - np.array(self.rest, object)) ** 2).sum(axis=1)
        return [s if s < 1 << 63 else None for s in map(int, sums)]


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix by cyclic Jacobi rotations, largest eigenvalue first.

    A sweep takes every pair of indices once, in rounds of disjoint pairs. Each vector's largest entry is positive.
    """
    a = np.array(matrix, np.longdouble)
    d = a.shape[0]
    v = np.eye(d, dtype=np.longdouble)
    eps = np.finfo(np.longdouble).eps
    least = eps * eps * np.abs(a).max(initial=0)
    order = list(range(d + d % 2))
    half = len(order) // 2
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(order) - 1):
            pairs = [(x, y) for x, y in zip(order[:half], order[:half - 1:-1]) if x < d and y < d]
            order = [order[0], order[-1], *order[1:-1]]
            p, q = np.array(pairs, int).reshape(-1, 2).T
            off, dp, dq = a[p, q], a[p, p], a[q, q]
            on = np.abs(off) > np.maximum(eps * np.sqrt(np.abs(dp * dq)), least)
            if not on.any():
                continue
            turned = True
            p, q, off, dp, dq = p[on], q[on], off[on], dp[on], dq[on]
            theta = (dq - dp) / (2 * off)
            t = np.where(theta < 0, -1, 1) / (np.abs(theta) + np.sqrt(theta * theta + 1))
            c = 1 / np.sqrt(t * t + 1)
            s = t * c
            for m in (a.T, a, v.T):  # columns, rows, and the columns of v
                x, y = m[p], m[q]
                m[p], m[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
            a[p, p], a[q, q] = dp - t * off, dq + t * off
            a[p, q] = a[q, p] = 0
        if not turned:
            break
    e = np.diag(a)
    by = np.argsort(-e, kind="stable")
    v = v[:, by] / np.sqrt((v[:, by] ** 2).sum(axis=0))
    top = np.take_along_axis(v, np.abs(v).argmax(axis=0)[None], 0) if d else v
    return e[by], v * np.where(top < 0, -1, 1)


def scaled(vec: Column) -> Column:
    """The whole-number vector, null where the vector is left out."""
    v = vec.cast("array<double>")
    fit = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST))
    return F.when(fit, F.transform(v, lambda c: F.floor(c * SCALE) + OFFSET))


def _blocks(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for d, x in by_length(batch.column(at)):
            step = max(1, min(EXACT_ROWS, BLOCK // max(d, 1)))
            for k in range(0, len(x), step):
                yield d, x[k : k + step]


def _sums(vectors: DataFrame) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, and each dimension: rows, sum, least, greatest."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for d, x in _blocks(batches):
            parts = [np.full(d, len(x)), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), x.min(axis=0), x.max(axis=0)]
            had = seen.get(d)
            seen[d] = parts if had is None else [had[0] + parts[0], had[1] + parts[1], had[2] + parts[2], np.minimum(had[3], parts[3]), np.maximum(had[4], parts[4])]
        for d, parts in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(np.arange(d, dtype=np.int32)), *map(pa.array, parts)], ["d", "i", "n", "high", "low", "least", "most"])

    rows = vectors.mapInArrow(partial, "d int, i int, n long, high long, low long, least long, most long").groupBy("d", "i")
    whole = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low")]
    out: dict[int, list] = {}
    for r in rows.agg(*whole, F.min("least").alias("least"), F.max("most").alias("most")).orderBy("d", "i").collect():
        out.setdefault(r.d, []).append((int(r.n), (int(r.high) << 32) + int(r.low), r.least, r.most))
    return out


def _scatter(vectors: DataFrame, shift: dict[int, np.ndarray], limbs: dict[int, int]) -> dict[int, np.ndarray]:
    """For each length the exact sum of outer products about `shift`, as a matrix of Python integers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for d, x in _blocks(batches):
            z, parts = x - shift[d], []
            for _ in range(limbs[d] - 1):
                parts.append((z & ((1 << LIMB) - 1)).astype(float))
                z = z >> LIMB
            parts.append(z.astype(float))
            if d not in sums:
                sums[d] = np.zeros((2 * limbs[d] - 1, d, d), np.int64)
            for i, a in enumerate(parts):
                for j, b in enumerate(parts):
                    sums[d][i + j] += (a.T @ b).astype(np.int64)
        for d, m in sums.items():
            i, j = np.triu_indices(d)
            for k in range(len(m)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(i.size, c, np.int32)) for c in (d, k)] + [pa.array(c.astype(np.int32)) for c in (i, j)] + [pa.array(m[k][i, j])], ["d", "k", "i", "j", "x"])

    rows = vectors.mapInArrow(partial, "d int, k int, i int, j int, x long").groupBy("d", "k", "i", "j")
    got = rows.agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).toArrow()
    d, k, i, j = (got[c].to_numpy() for c in ("d", "k", "i", "j"))
    x = np.array([int(v) << (LIMB * int(e)) for v, e in zip(got["x"].to_pylist(), k)], object)
    out = {length: np.zeros((length, length), object) for length in shift}
    for length in out:
        on = d == length
        np.add.at(out[length], (i[on], j[on]), x[on])
        low = np.tril_indices(length, -1)
        out[length][low] = out[length].T[low]
    return out


def fit(df: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of each vector length, fitted on all distinct vectors of `df`."""
    vectors = df.select(scaled(F.col(vec_col)).alias("x")).where("size(x) > 0").distinct()
    vectors = cut(vectors)
    sums = _sums(vectors)
    shift, limbs = {}, {}
    for d, dims in sums.items():
        # the nearest whole number to each mean
        shift[d] = np.array([(2 * s + n) // (2 * n) for n, s, _, _ in dims], np.int64)
        most = max(max(int(c) - lo, hi - int(c)) for c, (_, _, lo, hi) in zip(shift[d], dims))
        limbs[d] = max(1, -(-(most.bit_length()) // LIMB))
    out = {}
    for d, scatter in (_scatter(vectors, shift, limbs) if sums else {}).items():
        n = sums[d][0][0]
        rest = [s - n * int(c) for c, (_, s, _, _) in zip(shift[d], sums[d])]
        exact = n * scatter - np.outer(np.array(rest, object), np.array(rest, object))  # n^2 times the covariance
        v = np.array([[np.longdouble(str(int(x))) for x in row] for row in exact], np.longdouble).reshape(d, d) / (np.longdouble(n) * np.longdouble(n))
        e, axes = jacobi(v)
        total = np.trace(v)
        e = np.where(e > 64 * d * np.finfo(np.longdouble).eps * total, e, 0)[:components]
        furthest = sum(max(abs(n * (lo - int(c)) - r), abs(n * (hi - int(c)) - r)) ** 2 for c, r, (_, _, lo, hi) in zip(shift[d], rest, sums[d]))
        out[d] = Whitening(n, shift[d], rest, e.astype(float), axes[:, :components].astype(float), (e / total).astype(float) if total > 0 else None, furthest < 1 << 63)
    for d, error in _identity_errors(vectors, out).items():
        out[d].identity_error = error
    return out


def _identity_errors(vectors: DataFrame, model: dict[int, Whitening]) -> dict[int, float]:
    """For each length the largest absolute entry of the projections' covariance over the fit list minus the identity."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for d, x in _blocks(batches):
            w = model[d].project(x)[:, model[d].eigenvalues > 0]
            w = np.concatenate([w, np.ones((len(w), 1))], axis=1)  # the last row and column sum w itself
            sums[d] = sums.get(d, 0) + w.T @ w
        for d, m in sums.items():
            i, j = np.indices(m.shape).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(i.size, d, np.int32)), pa.array(i), pa.array(j), pa.array(m.ravel())], ["d", "i", "j", "x"])

    found: dict[int, np.ndarray] = {}
    for d, i, j, x in vectors.mapInArrow(partial, "d int, i int, j int, x double").groupBy("d", "i", "j").agg(F.sum("x")).collect() if model else []:
        k = int((model[d].eigenvalues > 0).sum())
        found.setdefault(d, np.zeros((k + 1, k + 1)))[i, j] = x / model[d].n
    out = {}
    for d, m in found.items():
        mean, covariance = m[-1, :-1], m[:-1, :-1]
        if mean.size:
            out[d] = float(np.abs(covariance - np.outer(mean, mean) - np.eye(mean.size)).max())
    return out


FIELDS = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"


def whiten(df: DataFrame, model: dict[int, Whitening], vec_col: str = "embedding") -> DataFrame:
    """The rows of `df` whose vector can be used, with n, deviation, whitened (one value a component), explained and identity_error;
    columns of `df` named like these give way to them. Lengths that the model doesn't know are left out."""
    schema = T.StructType.fromDDL(FIELDS)
    rows, name = positional(df)
    names = [c for c in df.columns if c not in schema.names]
    kept = [name[c] for c in names]
    rows = rows.select(*kept, scaled(F.col(name[vec_col])).alias("__x")).where(F.size("__x").isin([int(d) for d in model]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(kept))
            size = np.diff(column.offsets.to_numpy())
            step = max(1, BLOCK // max(int(size.max(initial=1)), 1))
            for k in range(0, len(column), step):
                part = column.slice(k, step)
                out: list[list] = [[None] * len(part) for _ in schema]
                for d in np.unique(size[k : k + step]):
                    m, at = model[int(d)], np.flatnonzero(size[k : k + step] == d)
                    block = next(by_length(part.take(pa.array(at))))[1]
                    share = None if m.explained is None else m.explained.tolist()
                    for i, off, w in zip(at, m.deviation(block), m.project(block).tolist()):
                        values = (m.n, off, [None if c != c else c for c in w], share or [None] * len(w), m.identity_error)
                        for field, value in zip(out, values):
                            field[i] = value
                types = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
                columns = [c.slice(k, step) for c in batch.columns[: len(kept)]] + [pa.array(c, t) for c, t in zip(out, types)]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *schema.names])

    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], *schema.fields])).toDF(*names, *schema.names)
