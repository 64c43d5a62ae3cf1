"""Rank statistics: pair AUC, conformal quantile, coverage and p-values, centroids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import nonconformity
from ..functions.vectors import dot, unit
from .lineage import cut, global_rank
from .retrieval import at_once, met, pairwise, whole


def centroid(vectors: DataFrame) -> DataFrame:
    """Unit vector of the mean: (c array<double>), one row. Sums are combined map-side by position."""
    at = vectors.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"))
    mean = at.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("c"))
    return mean.select(unit(F.col("c")).alias("c"))


def pair_auc(pairs: DataFrame) -> DataFrame:
    """Mann-Whitney AUC of sim for `same` over pairs(sim, same, i, j), with ordinal ranks (ties by i, j); NaN for one class."""
    ranked = global_rank(pairs, ["sim", "i", "j"])
    got = ranked.agg(F.sum(F.when(F.col("same"), F.col("rank"))).cast("double").alias("r"), F.count_if("same").cast("double").alias("p"), F.count_if(~F.col("same")).cast("double").alias("q"))
    auc = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))
    return got.select(F.when((F.col("p") > 0) & (F.col("q") > 0), auc).otherwise(F.lit(float("nan"))).alias("auc"))


def label_pairs(vectors: DataFrame) -> DataFrame:
    """All pairs i < j of (id, v, label), by blocks. For AUCs of whole tables see `label_auc`."""
    def reduce(ids, sims, cols):
        r, c = np.nonzero(ids[:, None] < cols)
        return pd.DataFrame({"i": ids[r], "j": cols[c], "sim": sims[r, c]})

    pairs = pairwise(vectors, None, reduce, "i long, j long, sim double")
    a = vectors.select(F.col("id").alias("i"), F.col("label").alias("la"))
    b = vectors.select(F.col("id").alias("j"), F.col("label").alias("lb"))
    return pairs.join(a, "i").join(b, "j").select("i", "j", "sim", (F.col("la") == F.col("lb")).alias("same"))


def sampled_pairs(vectors: DataFrame, n: int = 20_000, seed: int = 0) -> DataFrame:
    """J11, sampled: n draws of two of the vectors (id, v, label) each, with replacement; draws of one vector twice go, so a little fewer
    than n pairs (sim, same, i, j) come back. Draws are hashes of their number and the seed: reruns agree."""
    ranked = cut(global_rank(whole(vectors).select("id", "v", "label"), ["id"]))
    size = ranked.count()
    draw = lambda side: (F.pmod(F.xxhash64("k", F.lit(seed), F.lit(side)), F.lit(max(size, 1))) + 1).alias(f"r{side}")
    draws = vectors.sparkSession.range(n if size else 0).select(F.col("id").alias("k")).select("k", draw(0), draw(1)).where("r0 <> r1")
    a = ranked.select(F.col("rank").alias("r0"), F.col("id").alias("i"), F.col("v").alias("a"), F.col("label").alias("la"))
    b = ranked.select(F.col("rank").alias("r1"), F.col("id").alias("j"), F.col("v").alias("b"), F.col("label").alias("lb"))
    return draws.join(a, "r0").join(b, "r1").select(dot(F.col("a"), F.col("b")).alias("sim"), F.col("la").eqNullSafe(F.col("lb")).alias("same"), "i", "j")


#: Similarities that fall into one of 2^SIM_BITS equal parts of [-1, 1] count as equal; bits of the parts that are summed in one window.
SIM_BITS, PART_BITS = 20, 10


def label_auc(vectors: DataFrame) -> DataFrame:
    """J11, G13 over all pairs of unit vectors (id, v, label): (auc), NaN for one class. No pair is written: each task
    passes on a histogram of the similarities that it saw, for equal and for different labels. Pairs of one cell (2e-6 wide) count as ties."""
    top = (1 << SIM_BITS) - 1

    def run(pairs):
        counts = np.zeros(2 * top + 2, np.int64)  # of different labels, then of equal ones
        for _, x, rows, y, cols in pairs:
            i, j = x.column("id").to_numpy(), y.column("id").to_numpy()
            g, h = x.column("label").to_numpy(), y.column("label").to_numpy()
            own = np.array_equal(i, j)
            for k in range(0, i.size, at_once(j.size)):
                part = slice(k, k + at_once(j.size))
                sims = rows[part] @ cols.T
                sims += 1
                sims *= 0.5 * (top + 1)
                bins = np.clip(sims, 0, top, out=sims).astype(np.int32)
                bins[g[part, None] == h] += top + 1
                counts += np.bincount(bins[i[part, None] < j] if own else bins.ravel(), minlength=counts.size)
        p, q = counts[top + 1 :], counts[: top + 1]
        at = np.flatnonzero(p + q)
        yield pd.DataFrame({"bin": at.astype(np.int32), "p": p[at], "q": q[at]})

    rows = vectors.where(F.col("label").isNotNull()).select("id", "v", F.col("label").cast("long").alias("label"))
    hist = met(rows, None, run, "bin int, p long, q long", once=True).groupBy("bin").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    hist = cut(hist.withColumn("part", F.shiftright("bin", PART_BITS)))
    # At most 2^(SIM_BITS - PART_BITS) parts.
    parts = hist.groupBy("part").agg(F.sum("q").alias("n")).withColumn("below", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    less = F.coalesce(F.sum("q").over(Window.partitionBy("part").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hist = hist.withColumn("less", less).join(parts.select("part", "below"), "part")
    got = hist.agg(F.sum(F.col("p") * (F.col("below") + F.col("less") + F.col("q") / 2)).alias("w"), F.sum("p").cast("double").alias("p"), F.sum("q").cast("double").alias("q"))
    return got.select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("w") / F.col("p") / F.col("q")).otherwise(F.lit(float("nan"))).alias("auc"))


def conformal_model(scores: DataFrame, eps: float = 0.05) -> DataFrame:
    """One row (n, q, coverage) from calibration nonconformities `s`.

    q is the ceil((n + 1)(1 - eps))-th smallest, infinite beyond n. Leave-one-out coverage: with
    k = ceil(n (1 - eps)), 1 if k > n - 1 (or n < 3), else the share of scores up to the k-th.
    """
    ranked = cut(global_rank(scores.select("s"), ["s"]))
    n = ranked.count()
    # In doubles throughout, as ranks at ties depend on it.
    k = F.ceil(F.lit(float(n + 1)) * F.lit(1.0 - eps))
    k2 = F.ceil(F.lit(float(n)) * F.lit(1.0 - eps))
    at = ranked.agg(F.max(F.when(F.col("rank") == k, F.col("s"))).alias("q"), F.max(F.when(F.col("rank") == k2, F.col("s"))).alias("c"), F.max(k).alias("k"), F.max(k2).alias("k2"))
    upto = ranked.crossJoin(F.broadcast(at)).agg(F.count_if(F.col("s") <= F.col("c")).alias("m"))
    got = at.crossJoin(upto)
    cover = F.when((F.lit(n) < 3) | (F.coalesce("k2", F.lit(n)) > n - 1), F.lit(1.0)).otherwise(F.col("m") / n)
    return got.select(F.lit(n).cast("long").alias("n"), F.coalesce("q", F.lit(float("inf"))).alias("q"), cover.alias("coverage"))


def conformal_test(tests: DataFrame, scores: DataFrame, model: DataFrame) -> DataFrame:
    """tests(id, s) with `inside` (s <= q) and p = (1 + #{calibration >= s}) / (n + 1).

    Counts come from one merged ranking of tests and calibration scores, not from their cross product.
    """
    both = scores.select("s", F.lit(1).alias("cal"), F.lit(None).cast("long").alias("id")).unionByName(tests.select("s", F.lit(0).alias("cal"), F.col("id").cast("long").alias("id")))
    # Tests come before calibration scores of the same value: those are at least as great.
    ranked = global_rank(both, ["s", "cal", "id"]).where("cal = 0").select("id", "s", "rank")
    # A test's rank less the tests ranked up to it: the calibration scores below it.
    own = global_rank(ranked, ["rank"], "nth").withColumn("below", F.col("rank") - F.col("nth"))
    out = own.crossJoin(F.broadcast(model))
    return out.select("id", "s", (F.col("s") <= F.col("q")).alias("inside"), ((F.lit(1) + F.col("n") - F.col("below")) / (F.col("n") + 1)).alias("p"))


def score_text(vectors: DataFrame, center: DataFrame) -> DataFrame:
    """proximity of each (id, v) to the centroid, and its nonconformity."""
    rows = vectors.crossJoin(F.broadcast(center)).withColumn("proximity", dot(F.col("v"), F.col("c")))
    return rows.select("id", "proximity", nonconformity(F.col("proximity")).alias("s"))


def build_identity(vectors: DataFrame, eps: float = 0.05) -> tuple[DataFrame, DataFrame, DataFrame]:
    """centroid, calibration scores and model of at least five vectors."""
    if vectors.limit(5).count() < 5:
        raise ValueError("calibration needs five vectors at least")
    center = centroid(vectors)
    scores = score_text(vectors, center)
    return center, scores, conformal_model(scores, eps)


def group_ids(rows: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """P11, DISTINCT: dense ids from 0, in key order, of key combinations with `least` members at least.

    Ids are ranked over the distinct keys, of which there are few, and joined back.
    """
    kept = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= least)
    ids = global_rank(kept, keys, "gid").withColumn("gid", F.col("gid") - 1)
    named = ids.select(*[F.col(k).alias(f"__{k}") for k in keys], "gid", "members")
    same = [rows[k].eqNullSafe(named[f"__{k}"]) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return rows.join(named, on).drop(*[f"__{k}" for k in keys])


def hash_split(id_col: Column, share: float = 0.2) -> Column:
    """L3: true for the test part; by the first digits of MD5, so other engines agree."""
    return F.conv(F.substring(F.md5(id_col.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 100 < int(share * 100)
