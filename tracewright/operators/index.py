"""An index of traces: vectors, priors, calibrated sharpness and separability, built once and recalled from many times."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double, unit
from . import learn, retrieval
from .encode import encode_cached, hash_encoder
from .lineage import cut


@dataclass(frozen=True)
class Index:
    """traces: as given, with `v`, the unit vector of the body. report: mean_top_mass, mean_active and collisions."""

    traces: DataFrame
    beta: float
    alpha: float
    report: dict
    encoder: Callable[[Column], Column]
    net: object | None

    def recall(self, cues: DataFrame, k: int = 3, salience_w: float = 0.1, diversity: float = 0.5) -> DataFrame:
        """cues(cue_id, cue), or with vectors (cue_id, q), to the k traces of each, with all columns of the traces."""
        if "q" not in cues.columns:
            q = cues.select(F.col("cue_id").alias("id"), self.encoder(F.col("cue")).alias("e")).select("id", unit(as_double(F.col("e"))).alias("v"))
            cues = cut(_projected(q, self.net).select(F.col("id").alias("cue_id"), F.col("v").alias("q")))
        got = retrieval.recall(self.traces.select("id", "v", "date", "salience", "channel_weight"), cues, k, self.beta, self.alpha, salience_w, diversity)
        known = [c for c in self.traces.columns if c not in got.columns and c != "v"]
        return got.join(self.traces.select("id", *known), "id")


def _projected(rows: DataFrame, net: object | None) -> DataFrame:
    return rows if net is None else learn.project(rows.select("id", "v"), net)


def build(
    traces: DataFrame, encoder: Callable[[Column], Column] = hash_encoder, cache: str | None = None, model: str = "hash64", net: object | None = None,
    beta: float | None = None, alpha: float = 1.5,
) -> Index:
    """traces(id, body, ...), or with vectors `v`. Ids are unique. cache: path of the embedding cache; net: a trained projection.

    Without a `beta` the gaps between each trace's two nearest others set it. No traces: ValueError. Null bodies have the zero
    vector, which is similar to nothing. Missing dates, saliences and channel weights are neutral.
    """
    rows = traces
    for name, kind in (("date", "string"), ("salience", "double"), ("channel_weight", "double")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    if "v" not in rows.columns:
        texts = rows.select("id", F.coalesce("body", F.lit("")).alias("text"))
        found = encode_cached(texts, cache, model, encoder) if cache else texts.withColumn("embedding", encoder(F.col("text")))
        rows = rows.join(found.select("id", unit(as_double(F.col("embedding"))).alias("v")), "id")
    if net is not None:
        rows = rows.drop("v").join(_projected(rows, net).select("id", "v"), "id")
    rows = cut(rows)
    if rows.isEmpty():
        raise ValueError("an index needs traces")
    vectors = rows.select("id", "v")
    two = None
    if beta is None:
        two = cut(retrieval.top_two(vectors))  # the greatest similarity serves the report too
        beta = float(retrieval.mean_gap(vectors, two).select(retrieval.beta_of(F.col("gap"), F.col("n")).alias("b")).first()["b"])
    report = retrieval.separability_report(retrieval.separability(vectors, beta, alpha, two)).first().asDict()
    return Index(rows, beta, alpha, report, encoder, net)
