"""The queries of this subpackage, one for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.llm import ann, chat, digest, langid, mixing, packing, repeats, secrets, simhash, sql, warc
from loomtide.llm.common import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources whole, the smaller ones up to twice, as rows in blocks."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, max_repeat=2.0).select("doc_id", "source", "block", "n_tokens", "order_key")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), k=4, radius=4)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.remove(_table(spark, sf_dir, "documents"), length=100))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a record for each page, then reads the archives back."""
    path = shared_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.digests(warc.read(spark, path, warc.DIGESTS))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return packing.pack(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), capacity=2048, end_id=0)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprint(_table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, -7, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.digest(chat.examples(turns))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def queries() -> dict:
    return {f.__name__: f for f in (op1_source_mixing, op2_simhash_near_dedup, op3_suffix_array_dedup, op4_warc, op5_language_id, op6_best_fit_packing, op7_fingerprints, op8_secret_scans, op9_chat_formatting, op10_nearest_neighbours)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
