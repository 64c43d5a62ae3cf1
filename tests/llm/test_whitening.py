"""Whitening against a brute-force version, with its edge cases."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tracewright.llm import queries, whitening

VECTORS = "vec_id long, embedding array<double>"


def brute(rows, most=16):
    """(id, component) -> (n, deviation, |whitened|, explained) by plain numpy and exact integers, for vectors of one length."""
    usable = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(c - Fraction(s, n)) for c, s in zip(x, sums)] for x in fit])
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    out = []
    for i, x in usable:
        off = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        p = np.array([float(c - Fraction(s, n)) for c, s in zip(x, sums)]) @ v[:, :most] / np.sqrt(e[:most])
        out += [(i, k + 1, n, off, abs(p[k]), e[k] / e.sum()) for k in range(min(most, len(e)))]
    return out


def rows_of(spark, rows, most=16):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    out = whitening.whiten(df, whitening.fit(df, components=most))
    return {r.vec_id: r for r in out.collect()}, out


def test_query(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    want = {(r[0], r[1]): r[2:] for r in brute([(r.vec_id, list(r.embedding)) for r in table])}
    got = queries.op11_whitening(spark, small).collect()
    assert len(got) == len(want) == 16 * len(table)
    signs = {}
    for r in got:
        n, off, w, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, off)
        assert abs(r.whitened) == pytest.approx(w, abs=1e-7) and r.explained == pytest.approx(share, rel=1e-9)
        assert r.identity_error < 1e-9 and r.identity_error == got[0].identity_error
    assert [f.dataType.simpleString() for f in queries.op11_whitening(spark, small).schema] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]


def test_copies_count_once(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=5).tolist()) for k in range(80)]
    rows += [(1000 + k, rows[7][1]) for k in range(500)] + [(7, rows[7][1]), (None, rows[3][1])]
    got, out = rows_of(spark, rows)
    assert out.count() == len(rows) and got[0].n == 80
    for i, k, n, off, w, share in brute(rows):
        assert (got[i].n, got[i].deviation) == (n, off) and abs(got[i].whitened[k - 1]) == pytest.approx(w, abs=1e-9) and got[i].explained[k - 1] == pytest.approx(share, rel=1e-9)
    assert got[1000].whitened == got[1499].whitened


def test_small_eigenvalues(spark):
    """Two nearly dependent dimensions beside each other: the third eigenvalue is about 1e-13 of the first."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(scale=3e4, size=(2, 400))
    rows = [(k, [float(a[k]), float(b[k]), float(a[k] + b[k])]) for k in range(400)]
    got, _ = rows_of(spark, rows)
    fit = np.array([[math.floor(64 * c) for c in v] for _, v in rows], dtype=object)
    n = len(fit)
    centred = [[Fraction(c) - Fraction(sum(col), n) for c, col in zip(x, fit.T)] for x in fit]
    v = [[sum(x[i] * x[j] for x in centred) / n for j in range(3)] for i in range(3)]
    det = v[0][0] * (v[1][1] * v[2][2] - v[1][2] ** 2) - v[0][1] * (v[0][1] * v[2][2] - v[1][2] * v[0][2]) + v[0][2] * (v[0][1] * v[1][2] - v[1][1] * v[0][2])
    trace = v[0][0] + v[1][1] + v[2][2]
    e = got[0].explained
    assert 1e-15 < e[2] < 1e-10
    assert e[0] * e[1] * e[2] == pytest.approx(float(det / trace**3), rel=1e-5)
    assert got[0].identity_error < 1e-4


def test_odd_vectors(spark):
    huge = float(1 << 40)
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [1e300, 0.0]), (None, [0.5, 0.25])]
    rows += [(10 + k, [k * 1.0, (k * k % 7) * 1.0]) for k in range(9)] + [(30, [1.0] * 3), (31, [1.0] * 3), (40, [huge, 0.0, 0.0, 0.0]), (41, [-huge, 1.0, 3.0, 0.0]), (42, [0.0, 1.0, 4.0, 0.0])]
    got, out = rows_of(spark, rows)
    assert set(got) == {None, 30, 31, 40, 41, 42, *range(10, 19)}
    for i, k, n, off, w, share in brute([r for r in rows if r[1] and len(r[1]) == 2 and r[0] not in (6,)]):
        assert (got[i].n, got[i].deviation) == (n, off) and abs(got[i].whitened[k - 1]) == pytest.approx(w, abs=1e-9)
    assert got[30].whitened == [None] * 3 and got[30].n == 1 and got[30].explained == [None] * 3 and got[30].deviation == 0
    assert got[40].n == 3 and got[40].deviation is None and got[40].whitened[0] == pytest.approx(1.5**0.5) and got[40].whitened[1:] == [None] * 3  # 1e-23 of the first
    df = spark.createDataFrame([], VECTORS)
    assert whitening.fit(df) == {} and whitening.whiten(df, {}).count() == 0


def test_clashing_columns(spark):
    rows = [(k, [k * 1.0, (k * k % 7) * 1.0], "kept", -1.0, "d") for k in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, whitened double, `a.b` string")
    out = whitening.whiten(df, whitening.fit(df))
    assert out.columns[:4] == ["vec_id", "embedding", "x", "a.b"] and out.where("x = 'kept' and size(whitened) = 2").count() == 9


def test_jacobi():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 33):
        a = rng.normal(size=(d, d))
        a = a + a.T
        e, v = whitening.jacobi(a)
        assert np.allclose((v * e) @ v.T, a.astype(np.longdouble), atol=1e-14) and np.allclose(e.astype(float), np.linalg.eigvalsh(a)[::-1])
        assert np.abs(v.T @ v - np.eye(d)).max() < 1e-16
