"""Sparse associative retrieval: similarities, weights, priors, base score, diverse selection, energy.

Weights of all but the strongest traces are exactly zero under entmax, so only traces that can be in its support are
sorted. What is known of a cue is joined to its rows by cue; nothing that grows with cues or memory is broadcast but by
`cosine`, whose cues are broadcast CUE_BYTES at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from ..functions.scoring import clamp, recency_date
from ..functions.vectors import dot, norm

#: Bytes of cues that are broadcast at once.
CUE_BYTES = 16 << 20
ACTIVE = 1e-3
#: Pairs of a trace and a cue that a task goes through on average, and that it holds.
PAIRS_A_TASK, PAIRS_AT_ONCE = 50_000_000, 1 << 18


def dots(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """All inner products, each added up from the first component to the last: equal vectors have equal ones wherever they stand."""
    out, one = np.zeros((len(rows), len(cols))), np.empty((len(rows), len(cols)))
    for x, y in zip(rows.T, np.ascontiguousarray(cols.T)):
        np.multiply(x[:, None], y[None, :], out=one)
        out += one
    return out


def _vectors_of(column: pa.ChunkedArray | pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix, and which of its rows are vectors of `dims` components without nulls; the others are zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    nulls = np.zeros(len(column), int)
    parent = np.repeat(np.arange(len(column)), np.maximum(size, 0))
    np.add.at(nulls, parent[flat.is_null().to_numpy(zero_copy_only=False)], 1)
    good = (size == dims) & (nulls == 0)
    out = np.zeros((len(column), dims))
    out[good] = flat.to_numpy(zero_copy_only=False)[good[parent]].reshape(-1, dims)
    return out, good


def over_cues(memory: DataFrame, cues: DataFrame, made: Callable[[np.ndarray, pa.Table], dict[str, np.ndarray]], schema: str, exact: bool = False) -> DataFrame:
    """A row for each of memory(id, v, ...) and cues(cue_id, q, ...): their other columns, and what made(similarities, cues) says of them, matrices of
    traces by cues (`schema`); null where a vector is.

    The memory passes the cues by batches, so nothing is shuffled but the memory, once; the cues are broadcast, in parts of about CUE_BYTES.
    """
    spark, out = memory.sparkSession, None
    size = cues.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("d")).first()
    parts = max(1, -(-size["n"] * max(size["d"] or 1, 1) * 8 // CUE_BYTES))
    tasks = max(4 * spark.sparkContext.defaultParallelism, memory.count() * size["n"] // PAIRS_A_TASK)
    memory = memory.withColumn("v", F.col("v").cast("array<double>")).repartition(tasks, "id")
    new = StructType.fromDDL(schema)
    kept = [c for c in memory.columns if c != "v"]
    fields = [*[f for f in cues.schema if f.name != "q"], *[memory.schema[c] for c in kept], *new]
    for k in range(parts):
        some = cues if parts < 2 else cues.where(F.pmod(F.xxhash64("cue_id"), F.lit(parts)) == k)
        told = spark.sparkContext.broadcast(some.withColumn("q", F.col("q").cast("array<double>")).toArrow())
        dims = size["d"] or 0

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            asked = told.value
            q, known = _vectors_of(asked.column("q"), dims)
            n, rest = len(q), asked.drop_columns(["q"]).combine_chunks()
            step = max(1, PAIRS_AT_ONCE // max(n, 1))
            for batch in batches if n else ():
                for f in range(0, batch.num_rows, step):
                    some = batch.slice(f, step)
                    v, whole = _vectors_of(some.column("v"), dims)
                    sims = dots(v, q) if exact else v @ q.T
                    none = None if whole.all() and known.all() else ~(whole[:, None] & known[None, :]).ravel()
                    row, cue = pa.array(np.repeat(np.arange(len(v)), n)), pa.array(np.tile(np.arange(n), len(v)))
                    columns = [rest.column(c).take(cue).combine_chunks() for c in rest.column_names] + [some.column(c).take(row) for c in kept]
                    columns += [pa.array(np.ascontiguousarray(x).ravel(), mask=none) for x in made(sims, rest).values()]
                    yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], [f.name for f in fields])

        now = memory.mapInArrow(run, StructType([StructField(f.name, f.dataType, True) for f in fields]))
        out = now if out is None else out.unionByName(now)
    return out


def cosine(memory: DataFrame, cues: DataFrame) -> DataFrame:
    """(cue_id, id, sim, ...) of unit vectors: memory(id, v, ...) by cues(cue_id, q, ...)."""
    return over_cues(memory, cues, lambda sims, _: {"sim": sims}, "sim double", exact=True)


def nearest_to_cues(memory: DataFrame, cues: DataFrame, k: int) -> DataFrame:
    """(cue_id, id, sim) of the k traces of memory(id, v) most similar to each of cues(cue_id, q), ties by id. A pair of blocks passes on
    k traces a cue, by similarities added up in order."""
    asked = cues.select(F.col("cue_id").alias("id"), F.col("q").alias("v"))

    def cell(x: pa.Table, rows: np.ndarray, y: pa.Table, cols: np.ndarray) -> pd.DataFrame:
        cue, ids, out = x.column("id").to_numpy(), y.column("id").to_numpy(), []
        for f in range(0, len(rows), at_once(len(cols))):
            some = rows[f : f + at_once(len(cols))]
            sims = some @ cols.T
            least = np.partition(sims, -k, axis=1)[:, -k] if k < ids.size else np.full(len(some), -np.inf)
            r, c = np.nonzero(sims >= least[:, None] - 1e-9)
            s = np.zeros(r.size)
            for d in range(cols.shape[1]):
                s += some[r, d] * cols[c, d]
            order = np.lexsort((ids[c], -s, r))
            r, c, s = r[order], c[order], s[order]
            on = np.arange(r.size) - np.searchsorted(r, r) < k
            out.append(pd.DataFrame({"cue_id": cue[f + r[on]], "id": ids[c[on]], "sim": s[on]}))
        return pd.concat(out)

    return top_k(blockwise(asked, memory.select("id", "v"), cell, "cue_id long, id long, sim double"), k, "cue_id")


def partition_of(memory: DataFrame, cues: DataFrame, beta: float) -> DataFrame:
    """(cue_id, m, t): greatest similarity of each cue to the memory, and the sum of exp(beta (sim - m))."""

    def mass(ids: np.ndarray, sims: np.ndarray, _: np.ndarray) -> pd.DataFrame:
        m = sims.max(axis=1)
        return pd.DataFrame({"cue_id": ids, "m": m, "t": np.exp(beta * (sims - m[:, None])).sum(axis=1)})

    got = pairwise(cues.select(F.col("cue_id").alias("id"), F.col("q").alias("v")), memory, mass, "cue_id long, m double, t double")
    got = got.groupBy("cue_id").agg(F.max("m").alias("m"), F.collect_list(F.struct("m", "t")).alias("p"))  # one entry a block
    return got.select("cue_id", "m", F.aggregate("p", F.lit(0.0), lambda a, p: a + p["t"] * F.exp(F.lit(beta) * (p["m"] - F.col("m")))).alias("t"))


def supports(cues: DataFrame, memory: DataFrame, beta: float, alpha: float, itself: bool = True, tops: DataFrame | None = None) -> DataFrame:
    """(cue_id, id, s): what can have weight under entmax for cues(cue_id, q): scores s = beta sim with (alpha - 1) s within 1 of the cue's greatest.

    A first pass over the blocks finds the greatest, if it isn't known: tops(id, top); a second one passes on what is near it, which a block by itself can't tell.
    """
    from .lineage import cut

    asked = cues.select(F.col("cue_id").alias("id"), F.col("q").alias("v"))

    def scored(x: pa.Table, rows: np.ndarray, y: pa.Table, cols: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        step = at_once(len(cols))
        _, own, same = ([], [], []) if itself else np.intersect1d(x.column("id").to_numpy(), y.column("id").to_numpy(), return_indices=True)
        own, same = np.asarray(own, int), np.asarray(same, int)
        for f in range(0, len(rows), step):
            s = rows[f : f + step] @ cols.T
            s *= beta
            on = (own >= f) & (own < f + step)
            s[own[on] - f, same[on]] = -np.inf
            yield slice(f, f + step), s

    def most(x: pa.Table, rows: np.ndarray, y: pa.Table, cols: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"id": x.column("id").to_numpy(), "top": np.concatenate([s.max(axis=1) for _, s in scored(x, rows, y, cols)])})

    if tops is None:
        tops = blockwise(asked, memory.select("id", "v"), most, "id long, top double").groupBy("id").agg(F.max("top").alias("top"))
    tops = cut(tops.select(F.col("id").alias("__id"), "top"))

    def cell(x: pa.Table, rows: np.ndarray, y: pa.Table, cols: np.ndarray) -> pd.DataFrame:
        i, j, out = x.column("id").to_numpy(), y.column("id").to_numpy(), []
        least = np.maximum(x.column("top").to_numpy() - 1 / (alpha - 1) - 1e-9, -1e300)
        for part, s in scored(x, rows, y, cols):
            r, c = np.nonzero(s > least[part, None])
            out.append(pd.DataFrame({"cue_id": i[part][r], "id": j[c], "s": s[r, c]}))
        return pd.concat(out)

    asked = asked.join(tops, F.col("id") == F.col("__id")).select("id", "v", "top")
    return blockwise(asked, memory.select("id", "v"), cell, "cue_id long, id long, s double")


def weights_of(s: np.ndarray, top: np.ndarray, share: np.ndarray, alpha: float) -> np.ndarray:
    """Weights of scores (traces by cues) from each cue's greatest score and its weight."""
    if alpha == 1:
        return share * np.exp(s - top)
    return np.maximum((alpha - 1) * (s - top) + share ** (alpha - 1), 0.0) ** (1 / (alpha - 1))


def thresholds(memory: DataFrame, cues: DataFrame, beta: float, alpha: float) -> DataFrame:
    """(cue_id, top, share, active) of cues(cue_id, q): greatest score, its weight, and, under entmax, how many traces weigh more than ACTIVE."""
    if alpha == 1:
        return partition_of(memory, cues, beta).select("cue_id", (F.col("m") * beta).alias("top"), (F.lit(1.0) / F.col("t")).alias("share"), F.lit(None).cast("long").alias("active"))
    weights = entmax(supports(cues, memory, beta, alpha), alpha)
    return weights.groupBy("cue_id").agg(F.max("s").alias("top"), F.max("w").alias("share"), F.count_if(F.col("w") > ACTIVE).alias("active"))


def weighed(memory: DataFrame, cues: DataFrame, beta: float, alpha: float = 1.5) -> DataFrame:
    """R1, R1s: (cue_id, id, sim, w, ...) of memory(id, v, ...) by cues(cue_id, q): a pass finds what gives each cue's weights, another writes them. No pair of a
    cue and a trace is shuffled. Pairs without a similarity have no weight: zero under entmax, null under softmax."""
    from .lineage import cut

    state = cut(thresholds(memory.select("id", "v"), cues, beta, alpha).select(F.col("cue_id").alias("__cue"), F.col("top").alias("__top"), F.col("share").alias("__share")))
    asked = cues.join(state, F.col("cue_id") == F.col("__cue"), "left").drop("__cue")

    def made(sims: np.ndarray, asked: pa.Table) -> dict[str, np.ndarray]:
        top, share = (asked.column(c).to_numpy() for c in ("__top", "__share"))
        return {"sim": sims, "w": weights_of(sims * beta, top, share, alpha)}

    out = over_cues(memory, asked, made, "sim double, w double").drop("__top", "__share")
    return out if alpha == 1 else out.withColumn("w", F.coalesce("w", F.lit(0.0)))


def top_k(sims: DataFrame, k: int = 4, by: str | None = None) -> DataFrame:
    """The k most similar traces, ties by id; of each cue if `by` is given."""
    order = [F.desc("sim"), F.asc("id")]
    if by is None:
        return sims.orderBy(*order).limit(k)
    w = Window.partitionBy(by).orderBy(*order)
    return sims.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def softmax(scores: DataFrame, by: str = "cue_id", score: str = "s") -> DataFrame:
    """R1s: weights that sum to 1 over each cue; the maximum and the sum are aggregates, not windows over all rows."""
    top = scores.groupBy(F.col(by).alias("__b")).agg(F.max(score).alias("__m"))
    rows = scores.join(top, F.col(by) == F.col("__b")).withColumn("__e", F.exp(F.col(score) - F.col("__m")))
    total = rows.groupBy(F.col("__b").alias("__c")).agg(F.sum("__e").alias("__t"))
    return rows.join(total, F.col("__b") == F.col("__c")).withColumn("w", F.col("__e") / F.col("__t")).drop("__b", "__c", "__m", "__e", "__t")


def _support(scores: DataFrame, by: str, score: str, alpha: float) -> tuple[DataFrame, DataFrame]:
    """Rows that can have weight under entmax: (alpha - 1) * score within 1 of the greatest; and the others."""
    top = scores.groupBy(F.col(by).alias("__b")).agg(F.max(score).alias("__m"))
    rows = scores.join(top, F.col(by) == F.col("__b")).drop("__b")
    rows = rows.withColumn("__z", (F.col(score) - F.col("__m")) * F.lit(alpha - 1)).drop("__m")
    return rows.where("__z > -1"), rows.where("__z <= -1")


def entmax15(scores: DataFrame, by: str = "cue_id", score: str = "s", order: str = "id") -> DataFrame:
    """R1 for alpha = 1.5, in closed form: running mean and mean square give the threshold of each prefix."""
    near, far = _support(scores, by, score, 1.5)
    run = Window.partitionBy(by).orderBy(F.desc("__z"), order).rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("__z"), order)))
    near = near.withColumn("__m", F.avg("__z").over(run)).withColumn("__q", F.avg(F.col("__z") * F.col("__z")).over(run))
    delta = (F.lit(1.0) - F.col("__k") * (F.col("__q") - F.col("__m") * F.col("__m"))) / F.col("__k")
    near = near.withColumn("__t", F.col("__m") - F.sqrt(F.greatest(delta, F.lit(0.0))))
    whole = Window.partitionBy(by)
    tau = F.max(F.when(F.col("__t") <= F.col("__z"), F.struct("__k", "__t"))).over(whole)["__t"]
    near = near.withColumn("__tau", tau)
    near = near.withColumn("w", F.pow(F.greatest(F.col("__z") - F.col("__tau"), F.lit(0.0)), 2.0))
    return near.drop("__k", "__m", "__q", "__t", "__tau", "__z").unionByName(far.withColumn("w", F.lit(0.0)).drop("__z"))


def sparsemax(scores: DataFrame, by: str = "cue_id", score: str = "s", order: str = "id") -> DataFrame:
    """R1 for alpha = 2, in closed form."""
    near, far = _support(scores, by, score, 2.0)
    ordered = Window.partitionBy(by).orderBy(F.desc("__z"), order)
    near = near.withColumn("__k", F.row_number().over(ordered))
    near = near.withColumn("__c", F.sum("__z").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    near = near.withColumn("__t", (F.col("__c") - 1) / F.col("__k"))
    tau = F.max(F.when(F.col("__t") < F.col("__z"), F.struct("__k", "__t"))).over(Window.partitionBy(by))["__t"]
    near = near.withColumn("__tau", tau).withColumn("w", F.greatest(F.col("__z") - F.col("__tau"), F.lit(0.0)))
    return near.drop("__k", "__c", "__t", "__tau", "__z").unionByName(far.withColumn("w", F.lit(0.0)).drop("__z"))


def entmax_rows(z: np.ndarray, alpha: float = 1.5, steps: int = 50) -> np.ndarray:
    """R1 for any alpha >= 1 over the rows of a matrix; bisection on the threshold."""
    if alpha < 1:
        raise ValueError("alpha must be at least 1")
    if alpha == 1:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    x = (alpha - 1) * z
    high = x.max(axis=1, keepdims=True)
    low = high - 1
    for _ in range(steps):
        mid = (low + high) / 2
        mass = (np.maximum(x - mid, 0) ** (1 / (alpha - 1))).sum(axis=1, keepdims=True)
        low, high = np.where(mass >= 1, mid, low), np.where(mass >= 1, high, mid)
    p = np.maximum(x - (low + high) / 2, 0) ** (1 / (alpha - 1))
    return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-12)


def entmax(scores: DataFrame, alpha: float = 1.5, by: str = "cue_id", score: str = "s", order: str = "id") -> DataFrame:
    """Closed forms where there are any; else bisection over each cue's possible support."""
    if alpha < 1:
        raise ValueError("alpha must be at least 1")
    if alpha == 1:
        return softmax(scores, by, score)
    if alpha == 1.5:
        return entmax15(scores, by, score, order)
    if alpha == 2:
        return sparsemax(scores, by, score, order)
    near, far = _support(scores, by, score, alpha)
    near = near.drop("__z")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(w=entmax_rows(rows[score].to_numpy(float)[None, :], alpha)[0])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in near.schema)
    return near.groupBy(by).applyInPandas(solve, kinds + ", w double").unionByName(far.drop("__z").withColumn("w", F.lit(0.0)))


def priors(traces: DataFrame, date: str = "date", salience: str = "salience", weight: str = "channel_weight") -> DataFrame:
    """Recency, salience and channel priors in [0, 1]; the ranges are one row of aggregates."""
    day = F.datediff(recency_date(F.col(date)), F.lit("1970-01-01").cast("date"))
    chan = F.when(F.coalesce(F.col(weight), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(weight))
    rows = traces.withColumn("__d", day).withColumn("__w", chan)
    span = rows.agg(F.count("__d").alias("__n"), F.min("__d").alias("__d0"), F.max("__d").alias("__d1"), F.min("__w").alias("__w0"), F.max("__w").alias("__w1"))
    rows = rows.crossJoin(F.broadcast(span))
    ages = (F.col("__d") - F.col("__d0")) / F.greatest(F.lit(1), F.col("__d1") - F.col("__d0"))
    # Dates that are all the same tell nothing: the range counts as one day.
    rec = F.when((F.col("__n") < 2) | F.col("__d").isNull(), F.lit(0.5)).otherwise(ages)
    sal = F.when(F.coalesce(F.col(salience), F.lit(0.0)) > 0, F.col(salience) / 10).otherwise(F.lit(0.5))
    wide = F.col("__w1") - F.col("__w0")
    cha = F.when(wide < 1e-6, F.lit(0.5)).otherwise((F.col("__w") - F.col("__w0")) / wide)
    return rows.withColumns({"recency": rec, "salience_prior": sal, "channel_prior": cha}).drop("__d", "__w", "__n", "__d0", "__d1", "__w0", "__w1")


def base_score(recency_w: float = 0.1, salience_w: float = 0.1, channel_w: float = 0.1, weight: Column | None = None) -> Column:
    """R5."""
    return (F.col("w") if weight is None else weight) + F.lit(recency_w) * F.col("recency") + F.lit(salience_w) * F.col("salience_prior") + F.lit(channel_w) * F.col("channel_prior")


def mmr(base: np.ndarray, vectors: np.ndarray, k: int, diversity: float = 0.5, least: float = ACTIVE) -> list[int]:
    """Indices by maximal marginal relevance; ties go to the lower index."""
    pool = np.flatnonzero(base > least)
    if not pool.size:
        pool = np.array([int(np.argmax(base))]) if base.size else pool
    chosen: list[int] = []
    near = np.full(base.size, -np.inf)
    while pool.size and len(chosen) < k:
        value = base[pool] if not chosen else (1 - diversity) * base[pool] - diversity * near[pool]
        best = int(pool[np.argmax(value)])
        chosen.append(best)
        near = np.maximum(near, vectors @ vectors[best])
        pool = pool[pool != best]
    return chosen


def mmr_select(scored: DataFrame, k: int = 3, diversity: float = 0.5, by: str = "cue_id") -> DataFrame:
    """R6 for each cue: scored(cue_id, id, base, v) to (cue_id, id, base, pos).

    Each pick is one pass over the cue's candidates: the next one is the maximum of an aggregate, so no
    cue's candidates are brought together in a task. k is small and fixed.
    """
    from .lineage import cut

    left = cut(scored.where(F.col("base").isNotNull()))
    top = left.groupBy(by).agg(F.max("base").alias("__most")).withColumnRenamed(by, "__b")
    left = left.join(top, left[by] == top["__b"]).where((F.col("base") > ACTIVE) | ((F.col("__most") <= ACTIVE) & (F.col("base") == F.col("__most")))).drop("__b", "__most")
    left = left.withColumn("__near", F.lit(None).cast("double"))
    picks = None
    for pos in range(1, k + 1):
        value = F.when(F.col("__near").isNull(), F.col("base")).otherwise((1 - diversity) * F.col("base") - diversity * F.col("__near"))
        best = left.groupBy(by).agg(F.max_by(F.struct("id", "base", "v"), F.struct(value, -F.col("id"))).alias("p"))
        best = cut(best.select(F.col(by).alias("__b"), F.col("p.id").alias("__id"), F.col("p.base").alias("__base"), F.col("p.v").alias("__v")))
        one = best.select(F.col("__b").alias(by), F.col("__id").alias("id"), F.col("__base").alias("base"), F.lit(pos).alias("pos"))
        picks = one if picks is None else picks.unionByName(one)
        if pos < k:  # one row for each cue
            left = left.join(best, left[by] == best["__b"]).where("id <> __id")
            near = F.greatest(F.coalesce("__near", F.lit(float("-inf"))), dot(F.col("v"), F.col("__v")))
            left = cut(left.withColumn("__near", near).drop("__b", "__id", "__base", "__v"))
    return picks


def recall(memory: DataFrame, cues: DataFrame, k: int = 3, beta: float = 12.0, alpha: float = 1.5, salience_w: float = 0.1, diversity: float = 0.5) -> DataFrame:
    """(cue_id, id, pos, w, sim, score, recency, salience_prior, active) of the k traces recalled for each cue.

    memory(id, v, date, salience, channel_weight) with unit vectors, cues(cue_id, q).
    """
    from .diverse import diverse

    known = priors(memory).select("id", "v", "recency", "salience_prior", "channel_prior")
    prior = base_score(salience_w=salience_w, weight=F.lit(0.0))
    picks = diverse(known.select("id", "v", prior.alias("prior")), cues, k, float(beta), alpha, diversity)
    out = picks.join(known.select("id", "recency", "salience_prior"), "id")
    return out.select("cue_id", "id", "pos", "w", "sim", F.col("base").alias("score"), "recency", "salience_prior", "active")


def energy_terms(sims: DataFrame, beta: float, most_sq: Column) -> DataFrame:
    """Hopfield energy of each cue from its similarities: sims(cue_id, sim), most_sq: |cue|^2 / 2 (column of sims)."""
    top = sims.groupBy("cue_id").agg(F.max("sim").alias("m")).withColumnRenamed("cue_id", "__b")
    rows = sims.withColumn("half", most_sq).join(top, F.col("cue_id") == F.col("__b"))
    got = rows.groupBy("cue_id").agg(F.max("m").alias("m"), F.sum(F.exp(F.lit(beta) * (F.col("sim") - F.col("m")))).alias("t"), F.max("half").alias("half"))
    return got.select("cue_id", (-(F.col("m") + F.log("t") / F.lit(beta)) + F.col("half")).alias("energy"))


def energies(memory: DataFrame, cues: DataFrame, beta: float) -> DataFrame:
    """(cue_id, energy) of each of cues(cue_id, q) in memory(id, v), by blocks."""
    half = cues.select(F.col("cue_id").alias("__cue"), (norm(F.col("q")) * norm(F.col("q")) / 2).alias("half"))
    got = partition_of(memory, cues, beta).join(half, F.col("cue_id") == F.col("__cue"))
    return got.select("cue_id", (-(F.col("m") + F.log("t") / F.lit(beta)) + F.col("half")).alias("energy"))


def energy(state: np.ndarray, memory: np.ndarray, beta: float) -> float:
    """R11 for one state."""
    d = memory @ state
    m = d.max()
    return float(-(m + np.log(np.exp(beta * (d - m)).sum()) / beta) + 0.5 * state @ state)


def settle(query: np.ndarray, memory: np.ndarray, beta: float, most: int = 20, tol: float = 1e-6, rise: float = 1e-6) -> dict:
    """The update to its fixed point; energies, steps, and whether the energy ever rose."""
    x = query.astype(float)
    energies, bad, steps = [energy(x, memory, beta)], -1, 0
    for steps in range(1, most + 1):
        new = memory.T @ entmax_rows(beta * (memory @ x)[None, :], 1.0)[0]
        energies.append(energy(new, memory, beta))
        if energies[-1] > energies[-2] + rise:
            bad = steps  # the last violation
        moved = float(np.linalg.norm(new - x))
        x = new
        if moved < tol:
            break
    mass = float(entmax_rows(beta * (memory @ x)[None, :], 1.0).max())
    done = steps < most or abs(energies[-1] - energies[-2]) < tol
    return {"energies": energies, "iterations": steps, "converged": done, "lyapunov_ok": bad < 0, "final_top_mass": mass, "spurious_step": bad, "energy_drop": energies[0] - energies[-1]}


def attended(states: DataFrame, memory: DataFrame | Blocks, beta: float) -> DataFrame:
    """(id, m, t, s) of states(id, v): of similarities d to the whole memory m = max d, t = sum of e = exp(beta (d - m)), s = sum of e times
    the memory's vectors. A task adds up the three over all blocks of the memory that it goes through, and passes on one row a state."""

    def run(pairs: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        at, ids = None, None
        for r, x, rows, y, cols in pairs:
            if r != at:
                if ids is not None:
                    yield pd.DataFrame({"id": ids, "m": m, "t": t, "s": list(s)})
                at, ids = r, x.column("id").to_numpy()
                m, t, s = np.full(ids.size, -np.inf), np.zeros(ids.size), np.zeros(rows.shape)
            step = at_once(len(cols))
            for f in range(0, len(rows), step):
                part = slice(f, f + step)
                d = rows[part] @ cols.T
                top = np.maximum(m[part], d.max(axis=1))
                kept = np.exp(beta * (m[part] - top))
                d -= top[:, None]
                d *= beta
                e = np.exp(d, out=d)
                t[part] = t[part] * kept + e.sum(axis=1)
                s[part] = s[part] * kept[:, None] + e @ cols
                m[part] = top
        if ids is not None:
            yield pd.DataFrame({"id": ids, "m": m, "t": t, "s": list(s)})

    parts = met(states.select("id", "v"), memory if isinstance(memory, Blocks) else memory.select("id", "v"), run, "id long, m double, t double, s array<double>")
    parts = parts.groupBy("id").agg(F.max("m").alias("m"), F.collect_list(F.struct("m", "t", "s")).alias("p"))  # one entry a task that met a state
    scale = lambda p: F.exp(F.lit(beta) * (p["m"] - F.col("m")))
    t = F.aggregate("p", F.lit(0.0), lambda a, p: a + p["t"] * scale(p))
    zero = F.transform(F.element_at("p", 1)["s"], lambda x: F.lit(0.0))
    s = F.aggregate("p", zero, lambda a, p: F.zip_with(a, p["s"], lambda x, y: x + y * scale(p)))
    return parts.select("id", "m", t.alias("t"), s.alias("s"))


def settle_by_blocks(states: DataFrame, memory: DataFrame, beta: float, most: int = 20, tol: float = 1e-6, rise: float = 1e-6) -> DataFrame:
    """R12 for states(id, v) against a memory of any size: what `settle` does, one pass over the memory for each step."""
    from .lineage import cut

    live = states.select("id", F.col("v").cast("array<double>").alias("v"), F.array().cast("array<double>").alias("energies"), F.lit(0.0).alias("moved"), F.lit(-1).alias("bad"))
    memory = memory if isinstance(memory, Blocks) else packed(memory.select("id", "v"))  # once for all steps
    done = None
    for step in range(most + 1):
        seen = attended(live, memory, beta).withColumnRenamed("id", "__id")
        now = live.join(seen, live.id == F.col("__id")).drop("__id")
        size = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
        now = now.withColumn("e", -(F.col("m") + F.log("t") / F.lit(beta)) + F.lit(0.5) * size("v"))
        if step:
            now = now.withColumn("bad", F.when(F.col("e") > F.element_at("energies", -1) + rise, step).otherwise(F.col("bad")))
        now = now.withColumn("energies", F.concat("energies", F.array("e"))).withColumn("next", F.transform("s", lambda x: x / F.col("t")))
        apart = F.sqrt(F.aggregate(F.zip_with("next", "v", lambda x, y: x - y), F.lit(0.0), lambda a, x: a + x * x))
        ends = F.lit(step == most) | (F.lit(step > 0) & (F.col("moved") < tol))
        now = cut(now.select("id", "energies", "bad", "t", ends.alias("ends"), F.when(~ends, F.col("next")).alias("next"), apart.alias("moved")))
        last, before = F.element_at("energies", -1), F.element_at("energies", -2) if step else F.lit(None).cast("double")
        ended = now.where("ends").select(
            F.col("id").alias("cue_id"), "energies", F.lit(step).alias("iterations"), (F.lit(step < most) | (F.abs(last - before) < tol)).alias("converged"),
            (F.col("bad") < 0).alias("lyapunov_ok"), (F.lit(1.0) / F.col("t")).alias("final_top_mass"), F.col("bad").alias("spurious_step"), (F.element_at("energies", 1) - last).alias("energy_drop"),
        )
        done = ended if done is None else done.unionByName(ended)
        live = now.where("not ends").select("id", F.col("next").alias("v"), "energies", "moved", "bad")
        if live.isEmpty():
            break
    return done


def iterative_recall(memory: DataFrame, cues: DataFrame, beta: float) -> DataFrame:
    """R12 for a table of cues(cue_id, q): one pass over the memory, by blocks, for each step of all cues at once."""
    return settle_by_blocks(cues.select(F.col("cue_id").cast("long").alias("id"), F.col("q").alias("v")), memory, beta)


def _perturbed(memory: DataFrame) -> DataFrame:
    """(id, v): each vector with noise seeded by its place in the order of ids, of length 1."""
    from .lineage import global_rank

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = [np.asarray(x, float) + 0.15 * np.random.default_rng(int(k)).standard_normal(len(x)) for k, x in zip(batch["place"], batch["v"])]
            yield pd.DataFrame({"place": batch["place"], "id": batch["id"], "v": [x / (np.linalg.norm(x) or 1.0) for x in v]})

    ranked = global_rank(memory.select("id", F.col("v").cast("array<double>").alias("v")), ["id"], "place").withColumn("place", F.col("place") - 1)
    return ranked.select("place", "id", "v").mapInPandas(run, "place long, id long, v array<double>")


def stability_report(memory: DataFrame, beta: float, probes: int | None = None) -> DataFrame:
    """Each pattern perturbed (seeded by its place) and settled; self-recall is tested unperturbed, in one step."""
    return _stability_by_blocks(memory, beta, probes).agg(
        F.count(F.lit(1)).alias("n_probed"), F.bool_and("ok").alias("all_lyapunov_ok"), F.avg("iterations").alias("mean_iterations"),
        F.max("iterations").alias("max_iterations"), F.avg(F.col("home").cast("double")).alias("self_recall_rate"), F.count_if(~F.col("ok")).alias("spurious_count"),
    )


def _stability_by_blocks(memory: DataFrame, beta: float, probes: int | None) -> DataFrame:
    from .lineage import cut

    start = cut(_perturbed(memory))
    start = start if probes is None else start.where(F.col("place") < probes)
    own = memory.select("id", F.col("v").cast("array<double>").alias("v"))
    memory = packed(own)
    settled = settle_by_blocks(start, memory, beta).select("cue_id", "iterations", F.col("lyapunov_ok").alias("ok"))
    own = own if probes is None else own.join(start.select("id"), "id", "left_semi")
    fixed = attended(own, memory, beta).select("id", F.transform("s", lambda x: x / F.col("t")).alias("v"))

    def reduce(ids: np.ndarray, sims: np.ndarray, cols: np.ndarray) -> pd.DataFrame:
        order = np.argsort(cols, kind="stable")
        best = order[sims[:, order].argmax(axis=1)]
        return pd.DataFrame({"id": ids, "s": sims[np.arange(ids.size), best], "other": cols[best]})

    nearest = pairwise(fixed, memory, reduce, "id long, s double, other long").groupBy("id").agg(F.max_by("other", F.struct("s", -F.col("other"))).alias("other"))
    return settled.join(nearest, settled.cue_id == nearest.id).select("iterations", "ok", (F.col("id") == F.col("other")).alias("home"))


# ------------------------------------------------------------------ all pairs


#: Rows of a block and bytes of its vectors at most; rows of a block that meet the other block's at once.
BLOCK_ROWS, BLOCK_BYTES, ROWS_AT_ONCE = 1 << 14, 8 << 20, 512
#: Rows of a batch that leaves a task.
OUT_ROWS = 4096
#: Similarities that a task holds at once.
HELD = 1 << 20


def at_once(cols: int) -> int:
    """Rows of a block that meet `cols` columns at once."""
    return max(1, min(ROWS_AT_ONCE, HELD // max(cols, 1)))


def whole(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and has no null in it: others are similar to nothing."""
    return vectors.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))


@dataclass(frozen=True)
class Blocks:
    """A table (id, v, ...) written as blocks (part, block): a row a block, a partition a row. A block is its rows as an Arrow stream."""

    table: DataFrame
    parts: int
    rows: int


def packed(vectors: DataFrame, least: int = 1) -> Blocks:
    """vectors(id, v, ...) in blocks, hash parts of the ids, so any ids will do. At least about `least` blocks if there are rows for them, and
    beyond that a multiple of it, so that tasks end together."""
    from .lineage import cut

    rows = whole(vectors)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first()
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(size["d"], 1))))
    n = max(1, -(-size["n"] // most))
    n = -(-n // least) * least if n >= least else max(n, min(-(-size["n"] // ROWS_AT_ONCE), least))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield _block(got)

    rows = rows.withColumn("v", F.col("v").cast("array<double>")).withColumn("__part", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return Blocks(cut(rows.repartitionById(n, F.col("__part")).mapInArrow(pack, "part int, block binary")), n, size["n"])


def _block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    part = batches[0].column("__part")[0]
    table = pa.Table.from_batches(batches).drop_columns(["__part"]).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "block"])


def met(vectors: DataFrame, others: DataFrame | Blocks | None, run: Callable[[Iterator[tuple]], Iterator[pd.DataFrame | pa.Table]], schema: str, once: bool = False) -> DataFrame:
    """Blocks of rows against blocks of columns: run(pairs) makes tables of the pairs of blocks that a task goes through, each with the number of the block
    of rows: (number, rows, their vectors, columns, their vectors).

    vectors(id, v, ...) and others(id, v, ...), or the vectors themselves. Both sides are written once as blocks; a task keeps a block of rows and reads blocks of
    columns one by one from what was written, so no side is shuffled for the other, and a task holds two blocks however large the tables are. Pairs of one block
    of rows follow each other: what a task adds up over them is as many rows as the block has. once: each two blocks of the vectors meet once.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    left = packed(vectors, cores)
    right = left if others is None else others if isinstance(others, Blocks) else packed(others, -(-cores // left.parts))
    # Fewer blocks of rows than cores: columns are gone through by several tasks.
    tasks = max(1, min(right.parts, -(-cores // left.parts)))
    x = left.table.select(F.col("part").alias("__r"), F.col("block").alias("__x"))
    y = right.table.select(F.col("part").alias("__c"), F.col("block").alias("__y")).coalesce(tasks)
    pairs = y.hint("shuffle_replicate_nl").crossJoin(x)  # reads the partitions of both sides as they were written
    if once:  # of (r, c) and (c, r) one, and as many of each r
        apart = F.pmod(F.col("__c") - F.col("__r"), F.lit(left.parts))
        pairs = pairs.where((apart * 2 < left.parts) | ((apart * 2 == left.parts) & (F.col("__r") < F.col("__c"))))
    shape = pa.schema([(f.name, pa_type(f)) for f in StructType.fromDDL(schema)])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at = None
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.column("__r")[k].as_py()
                if r != at:
                    at, x = r, _unpacked(batch.column("__x")[k])
                    rows = _matrix(x)
                y = _unpacked(batch.column("__y")[k])
                yield r, x, rows, y, _matrix(y)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in run(told(batches)):
            got = got if isinstance(got, pa.Table) else pa.Table.from_pandas(got, shape, preserve_index=False)
            yield from got.cast(shape).combine_chunks().to_batches(OUT_ROWS)

    return pairs.select("__r", "__x", "__y").mapInArrow(over, schema)


def _unpacked(block: pa.BinaryScalar) -> pa.Table:
    with pa.ipc.open_stream(block.as_buffer()) as stream:
        return stream.read_all()


def blockwise(vectors: DataFrame, others: DataFrame | Blocks | None, cell: Callable[[pa.Table, np.ndarray, pa.Table, np.ndarray], pd.DataFrame | pa.Table], schema: str) -> DataFrame:
    """`met` pair by pair: cell(rows, their vectors, columns, their vectors) makes a table of each pair of blocks."""
    return met(vectors, others, lambda pairs: (cell(*pair[1:]) for pair in pairs), schema)


def pa_type(f: StructField) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}[f.dataType.simpleString()]


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def pairwise(vectors: DataFrame, others: DataFrame | Blocks | None, reduce, schema: str) -> DataFrame:
    """`blockwise` by similarities: reduce(ids, sims, column ids) yields a pandas frame for some rows of a block against a block of columns."""

    def cell(x: pa.Table, rows: np.ndarray, y: pa.Table, cols: np.ndarray) -> pd.DataFrame:
        i, j = x.column("id").to_numpy(), y.column("id").to_numpy()
        step = at_once(j.size)
        return pd.concat([reduce(i[k : k + step], rows[k : k + step] @ cols.T, j) for k in range(0, i.size, step)])

    return blockwise(vectors.select("id", "v"), others if others is None or isinstance(others, Blocks) else others.select("id", "v"), cell, schema)


def top_two(vectors: DataFrame) -> DataFrame:
    """(id, s1, s2): the two greatest similarities of each vector to the others."""
    from .neighbours import nearest

    near = F.col("near")
    return nearest(vectors, 2).select("id", F.try_element_at(near, F.lit(1))["s"].alias("s1"), F.try_element_at(near, F.lit(2))["s"].alias("s2"))


def mean_gap(vectors: DataFrame, two: DataFrame | None = None) -> DataFrame:
    """N and the mean of the difference between the two greatest similarities (`top_two`, if known)."""
    return (top_two(vectors) if two is None else two).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("s1") - F.col("s2")).alias("gap"))


def beta_of(gap: Column, n: Column, target: float = 6.0) -> Column:
    """N < 2 gives 12, no gap 20, else ln(target) / gap within [4, 40]."""
    flat = F.coalesce(gap, F.lit(0.0)) < 1e-4
    return F.when(n < 2, F.lit(12.0)).when(flat, F.lit(20.0)).otherwise(clamp(F.log(F.lit(target)) / gap, 4.0, 40.0))


def alpha_of(gap: Column, n: Column, low: float = 1.5, high: float = 2.0) -> Column:
    """Sharper where traces are harder to tell apart."""
    return F.when(n < 2, F.lit(low)).otherwise(F.lit(low) + clamp(F.lit(1.0) - F.coalesce(gap, F.lit(0.0)) / 0.3, 0.0, 1.0) * (high - low))


def separability(vectors: DataFrame, beta: float, alpha: float = 1.5, two: DataFrame | None = None) -> DataFrame:
    """(id, top, rival, active): each vector's recall of the others: greatest weight, whose, and how many weigh.

    Only what can be in a row's support leaves a block. two: the vectors' `top_two`, if known.
    """
    tops = None if two is None else two.select("id", F.coalesce(F.col("s1") * beta, F.lit(float("-inf"))).alias("top"))
    near = supports(vectors.select(F.col("id").alias("cue_id"), F.col("v").alias("q")), vectors.select("id", "v"), beta, alpha, False, tops)
    w = entmax(near, alpha)
    return w.groupBy("cue_id").agg(
        F.max("w").alias("top"), F.max_by("id", F.struct("w", -F.col("id"))).alias("rival"), F.count_if(F.col("w") > ACTIVE).alias("active")
    ).withColumnRenamed("cue_id", "id")


def separability_report(each: DataFrame) -> DataFrame:
    """Means, and collisions (top weight below .65)."""
    hit = F.when(F.col("top") < 0.65, F.struct("id", "rival", "top"))
    return each.agg(F.coalesce(F.avg("top"), F.lit(1.0)).alias("mean_top_mass"), F.coalesce(F.avg("active"), F.lit(1.0)).alias("mean_active"), F.count(hit).alias("collisions"))
