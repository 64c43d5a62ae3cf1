"""Channels: loading, tagging, filtering and counting traces; log sinks and sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import body_full, cap_body, long_enough
from .schemas import GROWN


@dataclass(frozen=True)
class Channel:
    """A5: a loader returns a DataFrame of traces (title, body, channel, ...)."""

    name: str
    loader: Callable[[SparkSession], DataFrame]
    weight: float = 1.0
    enabled: bool = True


#: Weights of the channels.
WEIGHTS = {"writing": 1.0, "decision": 1.4, "report": 0.9, "projectdoc": 0.8, "idea": 1.1, "desktop": 1.2, "notes": 1.0}


def tagged(df: DataFrame, name: str, weight: float) -> DataFrame:
    """The registry's name is the channel; another one that the trace had becomes its subchannel."""
    had = F.col("channel") if "channel" in df.columns else F.lit("")
    sub = F.when((F.coalesce(had, F.lit("")) != "") & (had != name), had)
    return df.withColumn("subchannel", sub).withColumn("channel", F.lit(name)).withColumn("channel_weight", F.lit(float(weight)))


def load_all(spark: SparkSession, channels: list[Channel], only: list[str] | None = None, log: Callable[[str], None] = print) -> DataFrame | None:
    """Union of the channels; naming a parked one in `only` loads it, `only=[]` loads none.

    A loader that fails skips its channel. Traces with short bodies go, then long bodies are capped.
    """
    got = []
    for ch in channels:
        if (ch.name not in only) if only is not None else not ch.enabled:
            continue
        try:
            got.append(tagged(ch.loader(spark), ch.name, ch.weight))
        except Exception as e:  # one bad channel doesn't stop the others
            log(f"channel {ch.name} skipped: {e}")
    if not got:
        return None
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), got)
    return capped(rows)


def capped(rows: DataFrame) -> DataFrame:
    """Drop traces too short to teach, then cap bodies and keep the whole text aside."""
    rows = rows.where(long_enough(F.coalesce("body", F.lit(""))))
    return rows.withColumn("body_full", body_full(F.col("body"))).withColumn("body", cap_body(F.col("body")))


def channel_counts(rows: DataFrame) -> DataFrame:
    """S18, G1."""
    return rows.groupBy(F.coalesce("channel", F.lit("?")).alias("channel")).agg(F.count(F.lit(1)).alias("n"))


def load_grown(spark: SparkSession, path: str) -> DataFrame:
    """Approved outputs; lines that are no JSON raise, and so does a missing body."""
    rows = spark.read.schema(GROWN).json(path, mode="FAILFAST")
    return rows.withColumn("body", F.when(F.col("body").isNull(), F.raise_error("a grown entry needs a body").cast("string")).otherwise(F.col("body")))


def load_kind(verified: DataFrame, grown: DataFrame | None = None) -> DataFrame:
    """S3: verified entries, with the grown ones."""
    return verified if grown is None else verified.unionByName(grown, allowMissingColumns=True)


def legacy(rows: DataFrame) -> DataFrame:
    """Traces as (title, body, source, section, note, channel, date, kind, salience); absent fields are empty, salience 0."""
    text = ("title", "body", "source", "section", "note", "channel", "date", "kind")
    have = set(rows.columns)
    out = [F.coalesce(F.col(c) if c in have else F.lit(None).cast("string"), F.lit("")).alias(c) for c in text]
    return rows.select(*out, F.coalesce(F.col("salience").cast("double") if "salience" in have else F.lit(None).cast("double"), F.lit(0.0)).alias("salience"))


def append_log(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """K1 to K3: append records to a JSON log, partitioned where asked for."""
    out = df.write.mode("append")
    (out.partitionBy(*by) if by else out).json(path)


def body_stats(rows: DataFrame) -> DataFrame:
    """Least, median and greatest body length. Lengths are counted first, so that the median needs one entry for each length."""
    lengths = rows.groupBy(F.length("body").alias("n")).agg(F.count(F.lit(1)).alias("f")).where(F.col("n").isNotNull())
    return lengths.agg(F.min("n").cast("long").alias("least"), F.percentile("n", F.lit(0.5), F.col("f")).alias("median"), F.max("n").cast("long").alias("most"))
