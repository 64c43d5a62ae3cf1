"""Token counts from flat token files by separator scan.

A token file holds little-endian 16-bit ids and nothing else: no index, no lengths; every document ends
with the separator id. Files are cut into blocks; the separators of a block are found with one vectorised
comparison. A block knows how many separators it holds and what stands before the first and after the last;
a prefix sum of the counts numbers the documents, and only the pieces at block boundaries are
added up by number. Blocks need no order of work and no more memory than a block.

`write_files` makes such files: Spark's text writer puts out raw bytes with the separator as its line end,
so they reach any file system that Spark can write to. Each document starts with HEADER ids that spell its
integer id (sign, then base-`separator` digits, none of which is the separator), which `counts` reads back.

Files are bounded in bytes: a text of more than LONG bytes has a file of its own, of others FILE_DOCS share one. A file is read as one
value and gone through by blocks without copying it.

Null and empty texts have no tokens, null ids are spelled as such, repeated rows are counted one by one. Ids are read as longs;
what is no whole number counts as a null id. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, ensure_checkpoint_dir, map_text

SEPARATOR, HEADER, DIGITS = 50256, 6, 5
#: Bytes of a block; bytes from which a text has its own file, and other documents of a file at most: 512 MB, as a token has a byte at least.
BLOCK, LONG, FILE_DOCS = 4 << 20, 128 << 10, 2000


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def write_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> None:
    """Tokenise whole texts and write flat token files below `path`."""
    with open(ranks or default_ranks(), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    shared, pattern = df.sparkSession.sparkContext.broadcast(table), _pattern()  # the vocabulary
    made: list = []

    def compute(texts: list[str]) -> list[np.ndarray]:
        if not made:
            import tiktoken

            made.append(tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={}))
        return [np.array([np.array(made[0].encode_ordinary(t), "<u2").tobytes() for t in texts], object)]

    rows = df.select(F.col(id_col).try_cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = F.abs(F.coalesce(F.col("id"), F.lit(0)).cast("decimal(20,0)"))  # of the least long too
    limbs = [F.when(F.col("id").isNull(), 2).when(F.col("id") < 0, 1).otherwise(0)]
    for _ in range(DIGITS):
        limbs.append((size % SEPARATOR).cast("long"))
        size = F.call_function("div", size, F.lit(SEPARATOR).cast("long"))
    two = [F.unhex(F.concat(F.lpad(F.hex((x % 256).cast("long")), 2, "0"), F.lpad(F.hex(F.shiftright(x.cast("long"), 8)), 2, "0"))) for x in limbs]
    body = F.concat(*two, F.col("ids"))
    line_end = np.array([SEPARATOR], "<u2").tobytes().decode("iso-8859-1")
    long = F.coalesce(F.octet_length("text") > LONG, F.lit(False))
    for some, most in ((rows.where(~long), FILE_DOCS), (rows.where(long), 1)):
        docs = map_text(some, "text", compute, "ids binary").select(body.cast("string").alias("value"))
        out = docs.write.mode("append").option("encoding", "ISO-8859-1").option("lineSep", line_end)
        out.option("maxRecordsPerFile", most).option("compression", "none").text(path)


def scan(token_files: DataFrame, separator: int = SEPARATOR, block: int = BLOCK, header: int = HEADER) -> DataFrame:
    """(stream, nth, tokens, head): one row per document; head: its first `header` ids.

    token_files: (stream, part, content binary); the parts of a stream are read on from one to the next.
    What follows the last separator of a stream is a document too, if it holds any token.
    """
    files = token_files.where(F.length("content") > 0)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                content = batch.column(2)[row].as_buffer()
                for number, frm in enumerate(range(0, content.size, block)):
                    ids = np.frombuffer(content, "<u2", min(block, content.size - frm) // 2, frm)
                    at = np.flatnonzero(ids == separator)
                    begin = np.concatenate([[0], at + 1])
                    end = np.concatenate([at, [ids.size]])
                    head = [ids[a : min(a + header, b)].astype(np.int32) for a, b in zip(begin, end)]
                    n = begin.size
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array([batch.column(c)[row].as_py()] * n, batch.column(c).type) for c in range(2)),
                            pa.array(np.full(n, number, np.int32)),
                            pa.array(np.arange(n)),
                            pa.array(np.full(n, at.size)),
                            pa.array(end - begin),
                            pa.array(head, pa.list_(pa.int32())),
                        ],
                        ["stream", "part", "block", "k", "separators", "tokens", "head"],
                    )

    kinds = {f.name: f.dataType.simpleString() for f in files.schema}
    pieces = cut(
        files.select("stream", "part", "content").mapInArrow(find, f"stream {kinds['stream']}, part {kinds['part']}, block int, k long, separators long, tokens long, head array<int>")
    )
    order = Window.partitionBy("stream").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.where("k = 0").select(
        F.col("stream").alias("s"), F.col("part").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("separators").over(order), F.lit(0)).alias("before")
    )
    same = (pieces.stream == before.s) & (pieces.part == before.p) & (pieces.block == before.b)
    pieces = pieces.join(before, same).withColumn("nth", F.col("before") + F.col("k"))
    inner = pieces.where("k > 0 and k < separators").select("stream", "nth", "tokens", "head")
    edge = pieces.where("k = 0 or k = separators").groupBy("stream", "nth").agg(
        F.sum("tokens").alias("tokens"),
        F.max(F.col("k") < F.col("separators")).alias("closed"),
        F.array_sort(F.collect_list(F.when(F.col("tokens") > 0, F.struct("part", "block", "head")))).alias("heads"),
    )
    head = F.slice(F.flatten(F.transform("heads", lambda h: h["head"])), 1, header)
    edge = edge.where("closed or tokens > 0").select("stream", "nth", "tokens", head.alias("head"))
    return inner.unionByName(edge)


def counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """(id, n_tokens) of every row, by way of flat token files in the shared checkpoint folder."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tokens-{uuid.uuid4().hex}"
    write_files(df, path, id_col, text_col, ranks)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    docs = scan(files.select(F.col("path").alias("stream"), F.lit(0).alias("part"), "content"))
    spelled = F.lit(0).cast("decimal(25,0)")
    for k in range(HEADER, 1, -1):
        spelled = (spelled * SEPARATOR + F.element_at("head", k)).cast("decimal(25,0)")
    sign = F.element_at("head", 1)
    value = F.when(sign == 0, spelled).when(sign == 1, -spelled).cast("long")
    out = cut(docs.select(value.alias(id_col), (F.col("tokens") - HEADER).alias("n_tokens")))
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return out
