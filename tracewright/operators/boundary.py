"""Output screen: sensitive sentences by structure and by proximity to anchors; fail-closed.

Sentences meet the anchors once however often they occur, in blocks of sentences against blocks of anchors: neither side is
broadcast. Under `Contexts` they go by place instead, as numbers of words, and meet the anchors where their vectors are made. Sentences and anchors are encoded alike, by a function of a column (`hash_encoder`) or by `Contexts`, which
has learned from a corpus what words keep like company.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import structural_hit
from ..functions.text import sentences
from ..functions.vectors import as_double
from .contexts import Contexts
from .encode import hash_encoder
from .lineage import cut, stored
from .retrieval import CUE_BYTES, pairwise

Encoder = Callable[[Column], Column] | Contexts
MASK, HELD = "[sensitive: removed]", "[not verified: held]"
#: Family health, personal finance, family privacy, mental health.
ANCHORS = (
    "annemin sağlığı ve tedavisi, hastalığı, doktoru",
    "kazandığım para, gelirim, maaşım, ne kadar kazandığım",
    "ailemle yaşadığım özel, kişisel, mahrem bir an",
    "ruh halim, depresyonum, terapim, psikolojik durumum",
)


def encoded(texts: DataFrame, encoder: Encoder) -> DataFrame:
    """(id, v) of texts(id, s): unit vectors. Texts in which the encoder knows no word have none."""
    if isinstance(encoder, Contexts):
        return encoder.vectors(texts)
    return texts.select("id", as_double(encoder(F.col("s"))).alias("v"))


def anchor_vectors(spark: SparkSession, encoder: Encoder = hash_encoder, anchors: Sequence[str] = ANCHORS) -> DataFrame:
    """(a): the unit vectors of the anchors."""
    texts = spark.createDataFrame(list(enumerate(anchors)), "id long, s string")
    return encoded(texts, encoder).select(F.col("v").alias("a"))


def near(said: DataFrame, anchors: DataFrame, threshold: float, encoder: Encoder) -> DataFrame:
    """(id, near) of said(id, s): greatest similarity to an anchor, where it is at least the threshold. anchors(a). Vectors of `Contexts` meet the anchors where
    they are made, if these can be broadcast (CUE_BYTES); others are written and meet them in blocks."""
    spark, against = said.sparkSession, cut(anchors.select(F.monotonically_increasing_id().alias("id"), F.col("a").alias("v")))
    size = against.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if isinstance(encoder, Contexts) and 0 < size["n"] * max(size["d"] or 1, 1) * 8 <= CUE_BYTES:
        told = spark.sparkContext.broadcast(np.array([r.v for r in against.select("v").collect()], float).T)

        def finish(ids: pa.Array, v: np.ndarray) -> pa.Table:
            most = np.concatenate([(v[f : f + 512] @ told.value).max(axis=1) for f in range(0, len(v), 512)])
            on = np.flatnonzero(most >= threshold)
            return pa.table([ids.take(pa.array(on)), pa.array(most[on])], ["id", "near"])

        return encoder.made(said, finish, f"id {said.schema['id'].dataType.simpleString()}, near double")

    def reduce(ids: np.ndarray, sims: np.ndarray, _: np.ndarray) -> pd.DataFrame:
        most = sims.max(axis=1)
        return pd.DataFrame({"id": ids[most >= threshold], "near": most[most >= threshold]})

    return pairwise(cut(encoded(said, encoder)), against, reduce, "id long, near double").groupBy("id").agg(F.max("near").alias("near"))


def near_anchors(said: DataFrame, anchors: DataFrame, threshold: float, encoder: Encoder) -> DataFrame:
    """(s, near) of said(s), distinct sentences whose greatest similarity to an anchor, `near`, is at least the threshold. anchors(a)."""
    said = cut(said.select(F.monotonically_increasing_id().alias("id"), "s"))  # sentences go by numbers
    return said.join(near(said, anchors, threshold, encoder), "id").select("s", "near")


def screen(texts: DataFrame, anchors: DataFrame | None = None, threshold: float = 0.55, redact: bool = True, encoder: Encoder = hash_encoder) -> DataFrame:
    """texts(id, text) to (id, safe, flagged, reasons, redacted). anchors(a): unit vectors of the encoder, all of them used.

    A sentence is flagged for its structure first, else for its greatest similarity to an anchor. Every
    occurrence of a flagged sentence is masked. A null text can't be verified and is held.
    """
    why = lambda s: F.struct(s.alias("s"), structural_hit(s).alias("why"))
    rows = texts.select("id", "text", F.coalesce(F.transform(sentences(F.col("text")), why), F.array().cast("array<struct<s:string,why:string>>")).alias("told"))
    if anchors is None:
        got = rows.select("id", "text", F.filter("told", lambda h: h["why"].isNotNull()).alias("hits"))
    else:
        # Only sentences leave their text; what is found near an anchor comes back to it as places.
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
        said = rows.select("row", F.posexplode("told").alias("n", "h")).where("h.why is null").select("row", "n", F.col("h.s").alias("s"))
        if isinstance(encoder, Contexts):  # a sentence costs less to encode again than to shuffle with its equals
            places = near(said.select(F.struct("row", "n").alias("id"), "s"), anchors, threshold, encoder).select("id.row", "id.n")
        else:
            told = near_anchors(said.select("s").distinct(), anchors, threshold, encoder).select(F.col("s").alias("meant"))
            places = said.join(told, F.col("s") == F.col("meant"))
        places = places.groupBy(F.col("row").alias("__row")).agg(F.collect_set("n").alias("places"))
        meant = lambda h, n: F.when(F.array_contains(F.col("places"), n), F.struct(h["s"].alias("s"), F.lit("meaning").alias("why"))).otherwise(h)
        rows = rows.join(places, F.col("row") == F.col("__row"), "left")
        rows = rows.withColumn("told", F.when(F.col("places").isNull(), F.col("told")).otherwise(F.transform("told", meant)))
        got = rows.select("id", "text", F.filter("told", lambda h: h["why"].isNotNull()).alias("hits"))
    flagged = F.transform("hits", lambda h: h["s"])
    clean = F.aggregate("hits", F.col("text"), lambda t, h: F.replace(t, h["s"], F.lit(MASK)))
    known = F.col("text").isNotNull()
    return got.select(
        "id", ((F.size("hits") == 0) & known).alias("safe"), flagged.alias("flagged"), F.transform("hits", lambda h: h["why"]).alias("reasons"),
        F.when(known, clean if redact else F.col("text")).otherwise(HELD).alias("redacted"),
    )


def screen_or_hold(texts: DataFrame, anchors: Sequence[str] | DataFrame | None = ANCHORS, log: Callable[[str], None] = print, **how) -> DataFrame:
    """`screen`, fail-closed: if it can't be done, every text is held. anchors: texts, or vectors(a), or None for structure only."""
    try:
        if anchors is not None and not isinstance(anchors, DataFrame):
            anchors = anchor_vectors(texts.sparkSession, how.get("encoder", hash_encoder), anchors)
        return cut(screen(texts, anchors, **how))
    except Exception as e:  # what can't be verified isn't released
        log(f"screen failed, all held: {e}")
        none = F.array().cast("array<string>")
        return texts.select("id", F.lit(False).alias("safe"), none.alias("flagged"), F.array(F.lit(f"not verified: {type(e).__name__}")).alias("reasons"), F.lit(HELD).alias("redacted"))
