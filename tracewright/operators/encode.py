"""Encoders and the embedding cache.

The default encoder needs no model: signed feature hashing of lower-case words. It is lexical and will not find
paraphrases; a neural one can be passed as a function from a column of texts to array<float>.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_key
from .lineage import cut

DIMS = 64
WORDS = re.compile(r"[^\W_]+")


_KNOWN: dict[str, tuple[int, float]] = {}


def _bucket(word: str, dims: int) -> tuple[int, float]:
    """Bucket and sign of a word, from the first digits of its MD5; kept between batches up to a bound."""
    if (got := _KNOWN.get(word)) is None:
        if len(_KNOWN) > 500_000:
            _KNOWN.clear()
        code = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        got = _KNOWN[word] = (code, 1.0 if (code >> 16) % 2 == 0 else -1.0)
    return got[0] % dims, got[1]


def hashed(text: str, dims: int = DIMS) -> np.ndarray:
    """Unit vector of signed counts of lower-case words; zero without words only: where all signs cancel, the counts go without."""
    out = np.zeros(dims)
    found = [_bucket(word, dims) for word in WORDS.findall(text.lower())]
    for at, sign in found:
        out[at] += sign
    if found and not out.any():
        for at, _ in found:
            out[at] += 1.0
    return out / (np.linalg.norm(out) or 1.0)


def hash_encoder(text: Column, dims: int = DIMS) -> Column:
    """Arrow-batched `hashed`."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashed(t or "", dims).astype(np.float32))

    return encode(text)


def misses(texts: DataFrame, cache: DataFrame | None, model: str) -> DataFrame:
    """Distinct (text_sha1, text) that the cache doesn't hold for the model."""
    keyed = texts.select(text_key(F.col("text")).alias("text_sha1"), "text").groupBy("text_sha1").agg(F.first("text").alias("text"))
    if cache is None:
        return keyed
    return keyed.join(cache.where(F.col("model") == model).select("text_sha1"), "text_sha1", "left_anti")


class Store:
    """K4: an append-only store of embeddings, safe to write from several jobs at once and to lose them.

    A write puts its rows into a folder of its own and then its name into the manifest, as one file that is there or isn't. Readers see the folders
    in the manifest only, so what a killed job left behind counts for nothing. Two writers may add the same key: the row of the
    first name in order counts, the same for every reader. `compact` makes one folder of all, without the others' repeats.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.files = self.jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """Folders of the manifest, without those that a later one has replaced."""
        folder = self.jvm.Path(self.path, "commits")
        if not self.files.exists(folder):
            return []
        found = [s.getPath() for s in self.files.listStatus(folder) if s.getPath().getName().endswith(".json")]
        commits = {}
        for path in found:
            stream = self.files.open(path)
            try:
                commits[path.getName()[:-5]] = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        gone = {old for c in commits.values() for old in c["replaces"]}
        return sorted(set(commits) - gone)

    def read(self) -> DataFrame | None:
        """(model, text_sha1, embedding), one row a key; None if there is nothing."""
        names = self.names()
        if not names:
            return None
        rows = self.spark.read.schema(STORED).parquet(*[f"{self.path}/data/{n}" for n in names]).withColumn("__from", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        return rows.groupBy("model", "text_sha1").agg(F.min_by("embedding", "__from").alias("embedding"))

    def add(self, rows: DataFrame, replaces: list[str] = ()) -> str:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        rows.select("model", "text_sha1", F.col("embedding").cast("array<float>").alias("embedding")).write.parquet(f"{self.path}/data/{name}")
        self._commit(name, replaces)
        return name

    def _commit(self, name: str, replaces: list[str]) -> None:
        draft, done = (self.jvm.Path(f"{self.path}/commits", n) for n in (f"_{name}.tmp", f"{name}.json"))
        stream = self.files.create(draft, True)
        try:
            stream.write(bytearray(json.dumps({"replaces": list(replaces)}).encode()))
        finally:
            stream.close()
        if not self.files.rename(draft, done):
            raise OSError(f"commit {name} could not be published")

    def compact(self) -> None:
        """One folder in place of all that are in the manifest now; what is added meanwhile stays. Replaced folders may be deleted once no reader has them."""
        names = self.names()
        if len(names) > 1:
            self.add(self.read(), names)


STORED = "model string, text_sha1 string, embedding array<float>"


def encode_cached(texts: DataFrame, path: str, model: str = "hash64", encoder: Callable[[Column], Column] = hash_encoder) -> DataFrame:
    """texts(id, text) with `embedding`; only misses are encoded and added to the store, keyed by model and content. Null texts count as empty."""
    texts = texts.withColumn("text", F.coalesce("text", F.lit("")))
    store = Store(texts.sparkSession, path)
    fresh = cut(misses(texts, store.read(), model))
    if not fresh.isEmpty():
        store.add(fresh.select(F.lit(model).alias("model"), "text_sha1", encoder(F.col("text")).alias("embedding")))
    stored = store.read()
    if stored is None:
        return texts.select("*", text_key(F.col("text")).alias("text_sha1"), F.lit(None).cast("array<float>").alias("embedding"))
    return texts.withColumn("text_sha1", text_key(F.col("text"))).join(stored.where(F.col("model") == model).select("text_sha1", "embedding"), "text_sha1")
