"""Scores of paired, counterfactual prompts. responses: (model, pair_id, side, expected, decision, parse_ok)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expected_label(ground_truth: Column, side: str) -> Column:
    """The label of a side in "A: L1; B: L2"."""
    return F.nullif(F.regexp_extract(ground_truth, rf"(?:^|;\s*){side}:\s*([A-Z]+)", 1), F.lit(""))


def pair_score(responses: DataFrame) -> DataFrame:
    correct = F.coalesce(F.col("decision") == F.col("expected"), F.lit(False))
    return responses.groupBy("model", "pair_id").agg(F.count("*").alias("sides"), F.bool_and(correct).alias("passed"))


def violation_score(responses: DataFrame) -> DataFrame:
    """Share of failed pairs by model; FAIL unless it is 0 (the threshold is our reading)."""
    return violations_of(pair_score(responses))


def violations_of(pairs: DataFrame) -> DataFrame:
    """The same from pairs that are scored already (model, passed), by a batch or a stream."""
    per = pairs.groupBy("model").agg(F.count("*").alias("pairs"), F.count(F.when(~F.col("passed"), 1)).alias("failed"))
    score = F.round(F.col("failed") / F.col("pairs"), 2)
    return per.withColumn("score", score).withColumn("verdict", F.when(F.col("failed") == 0, "PASS").otherwise("FAIL"))


def collapsed(responses: DataFrame) -> DataFrame:
    """Does a model give one label whatever the prompt?"""
    return responses.groupBy("model").agg(F.count_distinct("decision").alias("labels")).withColumn("collapsed", F.col("labels") == 1)


def accuracy(responses: DataFrame) -> DataFrame:
    """Accuracy and share of malformed responses, kept apart."""
    right = F.avg(F.when(F.col("decision") == F.col("expected"), 1.0).otherwise(0.0))
    return responses.groupBy("model").agg(F.round(right, 6).alias("accuracy"), F.round(F.avg(F.when(F.col("parse_ok"), 0.0).otherwise(1.0)), 6).alias("malformed"))


def flips(responses: DataFrame) -> DataFrame:
    """Pairs whose expected labels differ: did the decision change?"""
    side = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    wide = responses.groupBy("model", "pair_id").agg(side("expected", "A").alias("ea"), side("expected", "B").alias("eb"), side("decision", "A").alias("da"), side("decision", "B").alias("db"))
    return wide.filter(F.col("ea") != F.col("eb")).select("model", "pair_id", (F.col("da") != F.col("db")).alias("flipped"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def majority_baseline(df: DataFrame, column: str) -> DataFrame:
    """Accuracy of always giving the most frequent value."""
    return distribution(df, column).agg(F.max("n").alias("most"), F.sum("n").alias("total")).withColumn("baseline", F.round(F.col("most") / F.col("total"), 6))
