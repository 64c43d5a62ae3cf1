"""The corpus pipeline: quality, toxicity, near-duplicates, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor. Models are fitted on
labelled rows of that input. All stages but the last return the columns of documents.

Null texts count as empty: they have a score of quality, no toxic terms, fingerprint 0 and size 0. Null ids,
sources and languages are values like any other. Rows that repeat, or share an id, go through each
for itself; near-duplicates leave one row a group, the one with the smallest id, then the least text. Columns are
handled by place, so further ones may have any name. An empty table, or one that a stage empties, stays one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import mixing, pieces, quality, simhash, toxicity
from tracewright.llm.common import ensure_checkpoint_dir, positional


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field accepts; it is fitted without the rows held out for its evaluation."""
    model = quality.train(docs, _labels(spark, sf_dir), where=~quality.held_out("doc_id"))
    rows, name = positional(docs)
    rows = quality.score(rows, model, name["text"], keep_text=True).where("predicted = 1")
    return rows.select(*name.values()).toDF(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't find toxic."""
    model = toxicity.train(docs, _labels(spark, sf_dir))
    rows, name = positional(docs)
    rows = toxicity.score(rows, model, name["text"], keep_text=True).where("predicted = 0")
    return rows.select(*name.values()).toDF(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates. One row of each group stays."""
    rows, name = positional(docs)
    return simhash.one_of_each(rows, name["doc_id"], name["text"]).toDF(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    rows, name = positional(docs)
    return mixing.taken(rows, name["doc_id"], name["text"], name["source"]).toDF(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    out = pieces.encode_table(docs.select("doc_id", "source", "lang", "text"))
    return out.select("doc_id", "source", "lang", F.size("ids").alias("n_pieces"), "ids", "decoded_ok")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: Trained models and XXH64 have no DuckDB equivalent; tests/llm/test_models.py holds the stages and run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again. A stage's folder is deleted
    once the next stage is written; the last one's is what the result reads."""
    ensure_checkpoint_dir(spark)
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}")
    files = base.getFileSystem(spark._jsc.hadoopConfiguration())
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    try:
        for name, stage in STAGES:
            path = spark._jvm.org.apache.hadoop.fs.Path(base, name)
            stage(spark, docs, sf_dir).write.parquet(path.toString())
            docs = spark.read.parquet(path.toString())
            if before is not None:
                files.delete(before, True)
            before = path
    except BaseException:
        files.delete(base, True)
        raise
    return docs
