"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors of a label are collapsed first, so a group of copies costs one comparison. The
distinct ones are cut into tiles: cells along the first principal axis as wide as two linked unit
vectors can be apart, and hash parts of a cell that holds more than one tile. Only tiles of the
same or of adjacent cells meet. Within a pair of tiles the vectors are rotated to their principal
axes; the dot product of the leading dimensions is accumulated first, the rest is bounded by the
product of the suffix norms, and pairs stop as soon as the bound is below the threshold. What is left
is decided by the cosine of the vectors as given, in double precision.

A pair of tiles returns link counts and a spanning forest, not its pairs, so no group of near
copies is written out as pairs. Vectors that are null, zero, or hold null or non-finite components,
and vectors without a label, link with nothing; nor do vectors of different length. Rows with a null
id count as links of others. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, by_length, components, cut, least_of_component

THRESHOLD = 0.98
#: Vectors of a tile, dimensions that one step accumulates, rows and pairs that are compared at once.
TILE, STEP, ROWS, PAIRS = 2048, 16, 512, 1 << 16
#: Slack of the bounds, which are taken in rotated coordinates; the decision itself has none.
SLACK = 1e-9


def second_moments(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Sum of outer products of the unit vectors, for each dimension count. vectors: column v."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, x in by_length(batch.column(0)):
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d * d, pa.int32()), pa.array(np.arange(d * d), pa.int32()), pa.array(m.ravel())], ["d", "at", "x"])

    rows = vectors.select("v").mapInArrow(partial, "d int, at int, x double").groupBy("d", "at").agg(F.sum("x").alias("x")).collect()
    out: dict[int, np.ndarray] = {}
    for d, at, x in rows:
        out.setdefault(d, np.zeros(d * d))[at] = x
    return {d: m.reshape(d, d) for d, m in out.items()}


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked rows the smaller label, in place, until both sides agree."""
    while True:
        a, b = label[i], label[j]
        on = a != b
        if not on.any():
            return
        i, j, a, b = i[on], j[on], a[on], b[on]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def linked_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= threshold between the rows of x and y (i < j if they are the same)."""
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    p, q = (x / nx[:, None]) @ axes, (y / ny[:, None]) @ axes
    dims = range(STEP, x.shape[1], STEP)
    rest = {d: (np.sqrt((p[:, d:] ** 2).sum(axis=1)), np.sqrt((q[:, d:] ** 2).sum(axis=1))) for d in dims}
    first = min(STEP, x.shape[1])
    for k in range(0, x.shape[0], ROWS):
        part = p[k : k + ROWS, :first] @ q[:, :first].T
        most = part + np.outer(rest[first][0][k : k + ROWS], rest[first][1]) if first in rest else part
        alive = most >= threshold - SLACK
        if same:
            alive &= np.arange(k, k + alive.shape[0])[:, None] < np.arange(y.shape[0])
        found_i, found_j = np.nonzero(alive)
        for c in range(0, found_i.size, PAIRS):
            i, j = found_i[c : c + PAIRS], found_j[c : c + PAIRS]
            dot, i = part[i, j], i + k
            for d in dims:
                to = min(d + STEP, x.shape[1])
                dot = dot + np.einsum("ij,ij->i", p[i, d:to], q[j, d:to])
                left = rest[to][0][i] * rest[to][1][j] if to in rest else 0
                go = dot + left >= threshold - SLACK
                i, j, dot = i[go], j[go], dot[go]
            exact = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j]) >= threshold
            yield i[exact], j[exact]


def tile_links(threshold: float, axes: dict[int, np.ndarray]):
    """Function of a pair of tiles: (node, links, root) of the rows that link."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        side = table["side"].to_numpy()
        column = table["v"].chunk(0) if table["v"].num_chunks else table["v"].combine_chunks()
        (d, x) = next(by_length(column))
        # Without tile b the pair is a tile with itself.
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not b.size
        b = a if same else b
        links, root = np.zeros(node.size, np.int64), np.arange(node.size)
        if a.size:
            for i, j in linked_pairs(x[a], x[b], axes[d], threshold, same):
                i, j = a[i], b[j]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                _join(root, i, j)
        on = np.flatnonzero(links)
        return pa.table({"node": node[on], "links": links[on], "root": node[root[on]]})

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `df`: id, n_links, component_id, kept."""
    v = F.col("v")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    fit = F.coalesce(fit & F.col("label").isNotNull(), F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(fit, v)).withColumn("label", F.when(F.col("v").isNotNull(), F.col("label")))
    distinct = rows.where("v is not null").groupBy("label", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("low"))
    nodes = cut(distinct.withColumn("node", F.monotonically_increasing_id()))

    axes = {}
    for d, m in second_moments(nodes).items():
        axes[d] = np.ascontiguousarray(np.linalg.eigh(m)[1][:, ::-1])
    wide = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-6)
    lead = F.lit(None).cast("array<double>")
    for d, a in axes.items():
        lead = F.when(F.size(v) == d, F.array(*[F.lit(float(x)) for x in a[:, 0]])).otherwise(lead)
    add = lambda s, x: s + x
    along = F.aggregate(F.zip_with(v, lead, lambda x, y: x * y), F.lit(0.0), add)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    cells = nodes.withColumn("dims", F.size(v)).withColumn("cell", F.floor(along / norm / wide).cast("int"))
    # How many tiles has a cell, and with which do its own meet?
    by = ["label", "dims", "cell"]
    counts = cells.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    counts = cut(counts)
    after = counts.select("label", "dims", (F.col("cell") - 1).alias("cell"), F.col("tiles").alias("after"))
    before = counts.select("label", "dims", (F.col("cell") + 1).alias("cell"), F.col("tiles").alias("before"))
    plan = counts.join(after, by, "left").join(before, by, "left").na.fill(0, ["after", "before"])
    # A cell's vectors are dealt to SALTS tasks; its one row of the plan meets them in each.
    plan = plan.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    cells = cells.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(plan, [*by, "salt"]).drop("salt").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))

    def meet(n, make):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array().cast("array<struct<cell:int,a:int,next:int,b:int,side:int>>"))

    def pair(cell, a, nxt, b, side):
        return F.struct(cell.alias("cell"), a.cast("int").alias("a"), F.lit(nxt).alias("next"), b.cast("int").alias("b"), side.cast("int").alias("side"))

    tile, cell = F.col("tile"), F.col("cell")
    pairs = F.concat(
        meet(F.col("tiles"), lambda k: pair(cell, F.least(tile, k), 0, F.greatest(tile, k), F.when(tile > k, 1).otherwise(0))),
        meet(F.col("after"), lambda k: pair(cell, tile, 1, k, F.lit(0))),
        meet(F.col("before"), lambda k: pair(cell - 1, k, 1, tile, F.lit(1))),
    )
    dealt = cells.select("label", "dims", "node", "copies", "v", F.explode(pairs).alias("p")).select("*", "p.*")
    got = dealt.groupBy("label", "dims", "cell", "a", "next", "b").applyInArrow(
        _selected(tile_links(threshold, axes)), "node long, links long, root long"
    )
    got = cut(got)
    comp = components(got.where("node <> root").select("node", "root"), "node", "root").withColumnRenamed("node", "n")
    links = got.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "m")
    all_ = nodes.join(comp, nodes.node == comp.n, "left").join(links, nodes.node == links.m, "left")
    all_ = all_.select("label", "v", "low", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    all_ = cut(all_)
    all_ = least_of_component(all_, "component", "low", "component_id").select(F.col("label").alias("l"), F.col("v").alias("w"), "n_links", "component_id")
    out = rows.join(all_, (rows.label == all_.l) & (rows.v == all_.w), "left")
    own = F.when(F.col("w").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.cast("long").alias("component_id"),
        F.col("id").eqNullSafe(own).alias("kept"),
    )


def _selected(run):
    def of(table: pa.Table) -> pa.Table:
        return run(table.select(["node", "copies", "v", "side"]))

    return of
