"""Diverse recall (R6, R7) in passes over the memory: no table of cues times memory is ever written.

The first pass finds, block by block, what can be in the support of a cue's weights; the support gives the cue's threshold, and with it any
trace's weight follows from its similarity alone. Each pick is another pass: blocks of traces meet blocks of cues, which carry their
threshold and what they have picked, and a pair of blocks passes on one trace a cue, the best by maximal marginal relevance.
Neither cues nor memory are broadcast or sorted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import retrieval
from .lineage import cut
from .retrieval import ACTIVE, at_once, blockwise, pairwise, weights_of

STATE = "id long, v array<double>, top double, share double, active long"
BEST = "cue_id long, id long, value double, base double, w double, sim double, v array<double>"


def thresholds(memory: DataFrame, cues: DataFrame, beta: float, alpha: float) -> DataFrame:
    """(cue_id, top, share, active) of cues(cue_id, q): greatest score, its weight, and how many traces weigh more than ACTIVE."""
    asked = cues.select(F.col("cue_id").alias("id"), F.col("q").alias("v"))
    if alpha == 1:
        # Every trace weighs something: blocks pass on their greatest score, sum of weights and the scores that can pass ACTIVE.
        def mass(ids: np.ndarray, sims: np.ndarray, _: np.ndarray) -> pd.DataFrame:
            s = sims * beta
            top = s.max(axis=1)
            return pd.DataFrame({"cue_id": ids, "m": top, "t": np.exp(s - top[:, None]).sum(axis=1), "near": [np.sort(r[r > m + np.log(ACTIVE)]) for r, m in zip(s, top)]})

        got = cut(pairwise(asked, memory, mass, "cue_id long, m double, t double, near array<double>"))
        top = got.groupBy("cue_id").agg(F.max("m").alias("top"))
        rows = got.join(top, "cue_id")
        total = rows.groupBy("cue_id").agg(F.max("top").alias("top"), F.sum(F.col("t") * F.exp(F.col("m") - F.col("top"))).alias("t"))
        counts = rows.select("cue_id", F.explode("near").alias("s")).join(total, "cue_id").where(F.exp(F.col("s") - F.col("top")) / F.col("t") > ACTIVE)
        counts = counts.groupBy("cue_id").agg(F.count(F.lit(1)).alias("active"))
        return total.join(counts, "cue_id", "left").select("cue_id", "top", (F.lit(1.0) / F.col("t")).alias("share"), F.coalesce("active", F.lit(0)).alias("active"))

    return retrieval.thresholds(memory, cues, beta, alpha)


def pick(memory: DataFrame, state: DataFrame, beta: float | None, alpha: float, diversity: float) -> DataFrame:
    """One pass: the best trace for each cue, (BEST). memory(id, v, prior); state(id, v, top, share, most, chosen, near): a cue with the ids and
    the flattened vectors of its picks. Without a beta the similarity itself is the base score."""

    def cell(x: pa.Table, rows: np.ndarray, y: pa.Table, cols: np.ndarray) -> pa.Table:
        order = np.argsort(x["id"].to_numpy(), kind="stable")  # ties go to the lower id
        ids, rows, prior = x["id"].to_numpy()[order], rows[order], x["prior"].to_numpy()[order]
        chosen, near = y["chosen"].combine_chunks(), y["near"].combine_chunks()
        n = len(chosen[0]) if len(chosen) else 0
        picked = chosen.flatten().to_numpy(zero_copy_only=False).reshape(len(y), n)
        vectors = near.flatten().to_numpy(zero_copy_only=False).reshape(len(y), n, -1) if n else None
        top, share, most = (y[c].to_numpy() for c in ("top", "share", "most"))
        out = []
        step = at_once(len(rows))
        for f in range(0, len(y), step):
            part = slice(f, f + step)
            sims = rows @ cols[part].T
            w = sims if beta is None else weights_of(sims * beta, top[part], share[part], alpha)
            base = w + prior[:, None]
            value = base.copy()
            if n:
                alike = np.full_like(sims, -np.inf)
                for k in range(n):
                    alike = np.maximum(alike, rows @ vectors[part, k].T)
                value = (1 - diversity) * base - diversity * alike
                value[~((base > ACTIVE) | ((most[part] <= ACTIVE) & (base == most[part])))] = -np.inf
                for k in range(n):
                    value[ids[:, None] == picked[part, k]] = -np.inf
            best, cue = value.argmax(axis=0), np.arange(value.shape[1])
            on = value[best, cue] > -np.inf
            best, cue = best[on], cue[on]
            won = np.ascontiguousarray(rows[best])
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(won) + 1, dtype=np.int32) * rows.shape[1]), pa.array(won.ravel()))
            columns = [y["id"].to_numpy()[part][cue], ids[best], *(c[best, cue] for c in (value, base, w, sims))]
            out.append(pa.table([*map(pa.array, columns), v], ["cue_id", "id", "value", "base", "w", "sim", "v"]))
        return pa.concat_tables(out)

    # A task keeps a block of cues and goes through the memory: what leaves it is a trace a cue.
    got = blockwise(state, memory, lambda y, cols, x, rows: cell(x, rows, y, cols), BEST)
    return got.groupBy("cue_id").agg(F.max_by(F.struct("id", "base", "w", "sim", "v"), F.struct("value", -F.col("id"))).alias("p")).select("cue_id", "p.*")


def diverse(memory: DataFrame, cues: DataFrame, k: int, beta: float | None, alpha: float = 1.5, diversity: float = 0.5) -> DataFrame:
    """(cue_id, id, pos, w, sim, base, active) of k picks for each cue of cues(cue_id, q); memory(id, v, prior). Without a beta the base score is
    the similarity and `active` is null. Traces without a base score take no part."""
    memory = cut(memory.where("v is not null and prior is not null").select("id", F.col("v").cast("array<double>").alias("v"), F.col("prior").cast("double").alias("prior")))
    state = cues.select(F.col("cue_id").alias("id"), F.col("q").cast("array<double>").alias("v"))
    if beta is None:
        state = state.select("*", *[F.lit(None).cast("double").alias(c) for c in ("top", "share")], F.lit(None).cast("long").alias("active"))
    else:
        known = thresholds(memory.select("id", "v"), cues, beta, alpha).withColumnRenamed("cue_id", "__id")
        state = state.join(known, F.col("id") == F.col("__id")).drop("__id")
    state = cut(state.select("*", F.lit(0.0).alias("most"), F.array().cast("array<long>").alias("chosen"), F.array().cast("array<double>").alias("near")))
    picks = None
    for pos in range(1, k + 1):
        best = cut(pick(memory, state.select("id", "v", "top", "share", "most", "chosen", "near"), beta, alpha, diversity))
        one = best.select("cue_id", "id", F.lit(pos).alias("pos"), "w", "sim", "base")
        picks = one if picks is None else picks.unionByName(one)
        if pos < k:  # cues without a further pick are through
            won = best.select(F.col("cue_id").alias("__cue"), F.col("id").alias("__id"), F.col("base").alias("__base"), F.col("v").alias("__v"))
            state = state.join(won, state.id == won["__cue"])
            most = F.col("__base") if pos == 1 else F.col("most")
            state = state.select("id", "v", "top", "share", "active", most.alias("most"), F.concat("chosen", F.array("__id")).alias("chosen"), F.concat("near", "__v").alias("near"))
            state = cut(state)
        if pos == 1:
            active = state.select(F.col("id").alias("cue_id"), "active")
    return picks.join(active, "cue_id")


