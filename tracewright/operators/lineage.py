"""Cutting lineage and ranking rows without a single-partition window."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Files of a query's shuffles are deleted once the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir. Only a local master without that setting, as in tests, gets a folder made."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tracewright-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there; survives lost executors. The shuffle files of what
    led to `df` are deleted, as nothing needs them any more."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # read when the plan is made, which select() does
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """As `cut`, but as a compressed table of columns, for rows that are many or that are read in part."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    table = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(table)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(table)


@contextmanager
def folder(spark: SparkSession, name: str) -> Iterator[tuple[Callable[[DataFrame, str], DataFrame], Callable[[str], None]]]:
    """store(df, table): `df` added to a table in a folder of its own in the checkpoint folder, and the table read again; drop(table). The folder goes at the end.

    Unlike a checkpoint a table is as large to the optimizer as its files are, whatever led to it: loops with joins need that.
    """
    ensure_checkpoint_dir(spark)
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}")
    files = base.getFileSystem(spark._jsc.hadoopConfiguration())

    def store(df: DataFrame, table: str) -> DataFrame:
        before = spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
        try:
            df.select("*").write.mode("append").option("compression", "zstd").parquet(f"{base.toString()}/{table}")
        finally:
            spark.conf.set(CLEANUP, before)
        return spark.read.schema(df.schema).parquet(f"{base.toString()}/{table}")

    def drop(table: str) -> None:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(base, table), True)

    try:
        yield store, drop
    finally:
        files.delete(base, True)


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """`df` with the 1-based rank of each row in the total order `order`.

    Rows are range-partitioned and sorted in parallel; what is summed in one place is a row count for
    each partition.
    """
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    parts = parts.withColumn("__part", F.spark_partition_id())
    parts = parts.withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row for each partition: bounded by the number of shuffle partitions.
    counts = F.broadcast(counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    return parts.join(counts, "__part").withColumn(name, F.col("__before") + F.col("__row") + 1).drop("__part", "__row", "__before")
