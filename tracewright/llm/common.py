"""Helpers shared by the training-data operators: connected components, text blocks, labelled samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import cut, ensure_checkpoint_dir

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components of an undirected graph: (node, component) with the smallest node.

    Alternates large-star and small-star steps. Each step takes the minimum of a node's neighbours
    with a map-side combine and joins it back with plain equi-joins, so a hub's adjacency is
    split by the skew join and never gathered in one task. Rounds grow with the logarithm of
    the longest path. Nodes without an edge are not returned; self-loops and repeats do no harm.
    """
    a, b = F.col(left), F.col(right)
    e = cut(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    )
    sign = _signature(e)
    while sign[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = cut(large)
        parent = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(parent, "hi")
            .where("lo <> m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(parent.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        e = cut(small)
        now = _signature(e)
        if now == sign:
            break
        sign = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


#: Tasks that the rows of one component are dealt to.
SALTS = 32


def least_of_component(nodes: DataFrame, component: str, value: str, name: str) -> DataFrame:
    """`nodes` with `name`: the least `value` of its component; nodes without a component keep their own.

    The minimum is combined map-side. It is joined back by component and a hash of the row, so that a component with a
    third of all nodes isn't one task.
    """
    salt = F.pmod(F.xxhash64(*nodes.columns), F.lit(SALTS))
    least = nodes.where(F.col(component).isNotNull()).groupBy(component).agg(F.min(value).alias(name))
    least = least.select(F.col(component).alias("__component"), name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__salt")).hint("merge")
    rows = nodes.where(F.col(component).isNotNull()).withColumn("__of", salt)
    named = rows.join(least, (F.col(component) == F.col("__component")) & (F.col("__of") == F.col("__salt"))).drop("__component", "__salt", "__of")
    return named.unionByName(nodes.where(F.col(component).isNull()).withColumn(name, F.col(value)))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each of n rows' components under the links (i, j)."""
    label = np.arange(n)
    while i.size:
        a, b = label[i], label[j]
        on = a != b
        i, j, low = i[on], j[on], np.minimum(a, b)[on]
        np.minimum.at(label, a[on], low)
        np.minimum.at(label, b[on], low)
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(length, matrix) of the lists of each length."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() :]
    start = np.cumsum(size) - size
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield int(d), flat[start[at][:, None] + np.arange(d)]


#: Characters of text that map_text works on at once.
BLOCK_CHARS = 1 << 21


def map_text(df: DataFrame, text_col: str, compute: Callable[[list[str]], list[np.ndarray]], fields: str, keep_text: bool = False) -> DataFrame:
    """`df` with columns computed from whole texts in blocks; null texts count as empty.

    compute gets the texts of a block and returns an array for each of `fields` (a DDL string). The
    rows' other columns are passed on, the text only if keep_text; columns named like a result give way to it.
    """
    schema = T.StructType.fromDDL(fields)
    source = df.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    kept = [c for c in df.columns if (keep_text or c != text_col) and c not in schema.names]
    source = source.select(*[F.col(f"`{c}`") for c in kept], *([] if keep_text else [F.col(f"`{text_col}`")]))
    at = source.columns.index(text_col)
    types = [pa.string() if f.dataType == T.StringType() else None for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
            k, before = 0, 0
            while k < len(column):
                to = max(k + 1, int(np.searchsorted(ends, before + BLOCK_CHARS, "right")))
                got = compute(column.slice(k, to - k).fill_null("").to_pylist())
                columns = [batch.column(i).slice(k, to - k) for i in range(len(kept))]
                columns += [pa.array(x, t) for x, t in zip(got, types)]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *schema.names])
                k, before = to, int(ends[to - 1])

    return source.mapInArrow(run, T.StructType([*[source.schema[c] for c in kept], *schema.fields]))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, most: int, where: Column | None = None) -> DataFrame:
    """At most `most` labelled ids, chosen by a hash of the id: (id_, label). Small enough to broadcast by that bound."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows if where is None else rows.where(where)
    rows = rows.groupBy(F.col(id_col).alias("id_")).agg(F.max(label_col).cast("int").alias("label"))
    return F.broadcast(cut(rows.orderBy(F.xxhash64("id_"), "id_").limit(most)))


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns named by place, and the new name of each: no name can clash then; toDF gives them back."""
    names = [f"c{k}" for k in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


__all__ = ["WORD", "by_length", "components", "cut", "ensure_checkpoint_dir", "labelled_sample", "least_of_component", "map_text", "positional", "roots"]
