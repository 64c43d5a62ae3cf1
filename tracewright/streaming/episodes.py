"""Optional: the episodic log as a stream. Each batch is scored, routed and appended to its stores.

Replays are harmless: bodies that a store holds aren't stored again. That look-up grows with the store, as the
log's meaning asks for (a body counts once, however late it repeats), so there is no watermark; the look-up
is a join with the store by hash and not streaming state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.loop import consolidated, reflected

EPISODE = "id long, text string, cue string, passed int, items int, smells boolean, weakest string, human_approved boolean"


def _held(spark: SparkSession, path: str) -> DataFrame | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.parquet(path).select("store", "body")


def consolidate_batch(batch: DataFrame, stores: str, log: str, least: float = 8.0) -> None:
    """O6 for one micro-batch: everything to the log, fresh gold and candidates to the stores."""
    spark = batch.sparkSession
    out = consolidated(reflected(batch, ("id",)), _held(spark, stores), least).persist()
    try:
        out.drop("fresh").write.mode("append").json(log)
        out.where("fresh").drop("fresh").write.mode("append").partitionBy("store").parquet(stores)
    finally:
        out.unpersist()


def stream(spark: SparkSession, source: str, stores: str, log: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Read JSON episodes from a folder as they come and consolidate them."""
    rows = spark.readStream.schema(EPISODE).json(source)
    out = rows.writeStream.foreachBatch(lambda b, _: consolidate_batch(b, stores, log)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
