"""Corpus pipeline: quality rules, language ID, near-dedup, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, the
Parquet table that the stage before it wrote. All but the last return the
columns of documents.

Edge cases, alike in all stages: an empty table gives an empty table; nulls in
columns other than the text, long texts and columns beyond those of documents
are carried along as they are (packing takes doc_id and text alone); each stage
says what it does with null and empty texts, ties and repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veridane.llm import language_id, packing, pii_bootstrap, repetition, simhash_dedup
from veridane.llm.shared import release, scope, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rule or the repetition limits reject; null and empty texts have too few words and go; equal rows fare alike."""
    return repetition.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, null texts among them, and those in no language that the labelled ones show; if none is labelled, all go. Ties go to the language first in the alphabet; equal rows fare alike."""
    return language_id.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one of the smallest id, of equal ids the first row, a null id last. Null, empty and blank texts are one group. Links are op9's: three words and 3 bits."""
    return simhash_dedup.keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by their kinds and makes n_chars fit; null texts stay null, equal rows fare alike."""
    return pii_bootstrap.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; a row for each piece. A null or empty text is its end id alone; equal rows are packed each."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("PII", pii),
    ("packing", pack),
]

#: Near-duplicate components and tokenizer ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope(spark) as keep:  # a stage's own tables go once its rows are written
            made = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep.append(made)
        release(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
