"""Queries of the training-data operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veridane.llm import bpe_speculative, chat_collapse, language_id, license_scan, merkle, merkle_manifest, op5_sql, packing, pii_bootstrap, repetition, secret_scan, simhash_dedup, source_divergence, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare(documents(spark, sf_dir))


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_speculative.encode_decode(documents(spark, sf_dir))


def op5_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(documents(spark, sf_dir)).drop("longest_repeat")


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.personal_data(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(documents(spark, sf_dir))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(documents(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_chat_collapse": op1_chat_collapse,
    "op2_token_counts": op2_token_counts,
    "op3_merkle_fingerprints": op3_merkle_fingerprints,
    "op4_bpe_encode_decode": op4_bpe_encode_decode,
    "op5_repetition_rules": op5_repetition_rules,
    "op6_pack_sequences": op6_pack_sequences,
    "op7_personal_data": op7_personal_data,
    "op8_language_id": op8_language_id,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_secret_scan": op12_secret_scan,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {"op1_chat_collapse": chat_collapse.ORACLE, "op5_repetition_rules": op5_sql.ORACLE, "op11_merkle_manifest": merkle_manifest.ORACLE, "op13_source_divergence": source_divergence.ORACLE}
