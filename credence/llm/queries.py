"""The registered queries of the ten corpus operators, one each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import ann, decontam, idstore, jaccard, langid, licenses, packing, pii, quality, sharding, twins


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(spark, _table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarise(licenses.detect(_table(spark, sf_dir, "documents")))


def op3_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_block_matrix_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark, _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(spark, _table(spark, sf_dir, "documents"))


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = langid.identify(spark, _table(spark, sf_dir, "documents"), F.coalesce(~held_out, F.lit(False)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(spark, _table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = idstore.write_store(spark, _table(spark, sf_dir, "documents"))
    return idstore.read_store(store).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_spans": op1_pii_spans,
    "op2_license_scan": op2_license_scan,
    "op3_co_training": op3_co_training,
    "op4_latent_decontamination": op4_latent_decontamination,
    "op5_block_matrix_ann": op5_block_matrix_ann,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_pack_sequences": op7_pack_sequences,
    "op8_language_id": op8_language_id,
    "op9_minimax_shards": op9_minimax_shards,
    "op10_id_store": op10_id_store,
}

ORACLE_SQL: dict[str, str] = twins.ORACLE_SQL
