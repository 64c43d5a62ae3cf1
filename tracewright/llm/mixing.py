"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every document has a 60-bit hash of its id and text. Tokens are summed by source and hash bucket;
the bucket in which a source's budget ends is refined into 1024 smaller ones, and so on, until it
holds one hash. Documents below the threshold so found are taken once more than the others. No
documents are sorted, and all that is kept of a source between the rounds is one row.

A target of k whole source sizes and a rest takes each document k times and, up to the rest, once
more. The document at the boundary is taken if that brings the source nearer to its target, so a
source misses its target by half of one document at most. Null texts have size 0, null sources
form the last source, equal rows (same id and text) share one hash and are taken together. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut

#: Weights of the sources in code-point order, repeated; budget as a share of all sizes; most copies.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Hash bits, and bits that each round of histograms resolves.
BITS, STEP = 60, 10


def unit_hash(id_col: Column, text_col: Column) -> Column:
    """60 bits of MD5 over id and text, as a long."""
    key = F.concat_ws("|", F.coalesce(id_col.cast("string"), F.lit("")), F.coalesce(text_col, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    Targets are proportional to the weights, stop at `most` times the size, and what is cut off is
    shared again. That ends at a level L with target = min(most * size, weight * L): sources are
    capped in order of size per weight for as long as the level of the others exceeds their cap.
    The windows run over one row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    by_ratio = everything.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    df = sizes.withColumn("weight", weight.cast("long")).withColumn("total", F.sum("source_size").over(everything))
    df = df.withColumn("capped", F.coalesce(F.sum("source_size").over(upto), F.lit(0)))
    df = df.withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    df = df.withColumn("level", (F.col("total") * F.lit(float(share)) - F.col("capped") * F.lit(float(most))) / F.col("rest"))
    # the first source, in order of size per weight, that its level doesn't cap
    free = F.when(F.col("source_size") * F.lit(float(most)) >= F.col("weight") * F.col("level"), F.struct(F.col("rest"), F.col("level")))
    df = df.withColumn("free", F.max(free).over(everything))
    target = F.least(F.col("source_size") * F.lit(float(most)), F.coalesce(F.col("weight") * F.col("free.level"), F.lit(float("inf"))))
    return df.select("source", "source_size", target.alias("target"))


def _histogram(docs: DataFrame, shift: int) -> DataFrame:
    """Tokens, least and greatest hash by source and hash bucket."""
    by = docs.groupBy("source", F.shiftright("hash", shift).alias("bucket"))
    return by.agg(F.sum("size").alias("tokens"), F.min("hash").alias("least"), F.max("hash").alias("most"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """One row per row of `df`: id, source, size, source_size, target, taken (tokens the mix takes), copies, hash."""
    text = F.col(text_col).cast("string")
    docs = df.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        unit_hash(F.col(id_col), text).alias("hash"),
    )
    docs = cut(docs)
    # The first histogram also gives the sizes of the sources.
    shift = BITS - STEP
    hist = cut(_histogram(docs, shift))
    plan = source_targets(hist.groupBy("source").agg(F.sum("tokens").alias("source_size")), weights, share, most)
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    plan = plan.withColumn("whole", F.least(whole, F.lit(most).cast("long")))
    plan = plan.withColumn("rest", F.when(F.col("whole") < most, F.col("target") - F.col("whole") * size).otherwise(0.0))
    state = cut(plan.withColumn("below", F.lit(0).cast("long")).withColumn("bucket", F.lit(None).cast("long")))
    while True:
        # Where in each source's histogram does the budget end?
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        upto = hist.withColumn("before", F.coalesce(F.sum("tokens").over(run), F.lit(0)))
        at = upto.alias("h").join(state.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
        at = at.where(F.col("s.below") + F.col("h.before") <= F.col("s.rest"))
        at = at.groupBy("s.source").agg(
            F.max(F.struct("h.bucket", "h.before", "h.tokens", "h.least", "h.most")).alias("end")
        )
        state = state.alias("s").join(at.alias("a"), F.col("s.source").eqNullSafe(F.col("a.source")), "left")
        state = state.select(
            F.col("s.source").alias("source"), "source_size", "target", "whole", "rest",
            (F.col("below") + F.coalesce("a.end.before", F.lit(0))).alias("below"),
            F.coalesce("a.end.bucket", "s.bucket").alias("bucket"),
            F.col("a.end.tokens").alias("tokens"), F.col("a.end.least").alias("least"), F.col("a.end.most").alias("most"),
        )
        state = cut(state)
        if not shift or state.where("least < most").isEmpty():
            break
        # Refine only the boundary bucket of each source.
        edge = docs.alias("d").join(
            state.where("least < most").select(F.col("source").alias("s"), F.col("bucket").alias("b")).alias("e"),
            F.col("d.source").eqNullSafe(F.col("e.s")) & (F.shiftright("d.hash", shift) == F.col("e.b")),
        ).select("d.*")
        shift -= STEP
        fine = _histogram(edge, shift)
        # Sources whose boundary is one hash already keep it.
        done = state.where("least = most").select("source", F.shiftright("least", shift).alias("bucket"), "tokens", "least", "most")
        hist = cut(fine.unionByName(done))
    # The boundary hash itself goes where the target is nearer.
    last = F.when(F.col("below") + F.col("tokens") / 2 <= F.col("rest"), F.col("least")).otherwise(F.col("least") - 1)
    limits = state.select(F.col("source").alias("s"), "source_size", "target", "whole", F.when(F.col("rest") > 0, last).otherwise(-1).alias("last"))
    limits = cut(limits)
    out = docs.join(limits, docs.source.eqNullSafe(limits.s))
    copies = F.col("whole") + F.when(F.col("hash") <= F.col("last"), 1).otherwise(0)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "hash")


def taken(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of `df`, each as often as the mix takes it. Rows are told apart by source, id and text: all equal ones are taken alike."""
    plan = mix(df, id_col, text_col, source_col, **how).where("copies > 0").groupBy("source", "hash").agg(F.max("copies").cast("int").alias("__copies"))
    plan = plan.select(F.col("source").alias("__source"), F.col("hash").alias("__hash"), "__copies")
    rows = df.withColumn("__of", unit_hash(F.col(id_col), F.col(text_col).cast("string")))
    rows = rows.join(plan, (rows["__of"] == plan["__hash"]) & rows[source_col].eqNullSafe(plan["__source"]))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(df.columns)
