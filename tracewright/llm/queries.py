"""The registered query of each training-data operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, edits, embeddings, html, mixing, oracles, pieces, quality, repeats, simhash, tokens, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", same), (-7, 1, "assistant", same)]
    talk = talk.unionByName(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.windows(talk))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    aside = quality.held_out("doc_id")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), where=~aside)
    return quality.score(docs, model).select("doc_id", aside.alias("held_out"), "score", "predicted")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counts(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.fingerprint_table(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("copies", "hash")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode_table(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(said.cast("binary"), 256).alias("ids_sha256"), "decoded_ok")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages, html.train(pages)).select("page_id", "url", "text", "n_chars")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = whitening.whiten(vectors, whitening.fit(vectors))
    out = out.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "c"))
    return out.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).drop("text")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_chat": op3_chat,
    "op4_quality": op4_quality,
    "op5_embeddings": op5_embeddings,
    "op6_tokens": op6_tokens,
    "op7_edits": op7_edits,
    "op8_mixing": op8_mixing,
    "op9_pieces": op9_pieces,
    "op10_html": op10_html,
    "op11_whitening": op11_whitening,
    "op12_repeats": op12_repeats,
    "op13_divergence": op13_divergence,
}
ORACLES: dict[str, str] = {"op3_chat": oracles.CHAT, "op5_embeddings": oracles.EMBEDDINGS, "op8_mixing": oracles.MIXING, "op12_repeats": oracles.REPEATS, "op13_divergence": oracles.DIVERGENCE}
