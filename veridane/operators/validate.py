"""Validation of question records: a flatmap to problems, and dataset gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridane.functions.text import comparable, ends_finished, leaks_instruction, too_short
from veridane.operators.clean import COSMETIC_IDS, FALSE_POSITIVE_IDS, MANUAL_IDS, let

#: Size of the shipped set.
EXPECTED_RECORDS, EXPECTED_STATEMENTS = 93, 301


def keys_in_order(entries: Column) -> Column:
    """Are the keys statement_1 to statement_n, in this order?"""
    return F.forall(F.transform(entries, lambda e, i: e["key"] == F.concat(F.lit("statement_"), (i + 1).cast("string"))), lambda ok: ok)


#: Messages of the problems.
MISSING, KEYS = "missing statements", "non-sequential keys: "
SHORT, LEAK, PUNCTUATION, SOURCE = " suspiciously short: ", " possible instruction leak: ", " may be missing final punctuation: ", " not found verbatim in original_question"
ENTRY = "array<struct<key:string,value:string>>"


def checked_units(questions: DataFrame, statements: str = "statements", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, pos, found): a row for each record (pos 0) and each of its statements (pos from 1), with its problems as (check, key, message).

    One pass: what a record's checks need is made before it is spread into rows; a statement's
    trimmed, lower-case and comparable forms are made once.
    """
    held = F.coalesce(F.col(statements), F.array().cast(ENTRY))
    checked = F.coalesce(~F.col("id").isin(*MANUAL_IDS, *FALSE_POSITIVE_IDS), F.lit(True))
    none = F.lit(None).cast("string")

    def found(check: str, key: Column, message: Column) -> Column:
        return F.named_struct(F.lit("check"), F.lit(check), F.lit("key"), key, F.lit("message"), message)

    record = questions.select("id", *keep, held.alias("e"), F.when(checked & (F.size(held) > 0), comparable(F.col("original_question"))).alias("source"))
    keys = found("keys", none, F.concat(F.lit(KEYS), F.array_join(F.transform("e", lambda x: x["key"]), ", ")))
    of_record = F.when(F.size("e") == 0, found("missing", none, F.lit(MISSING))).when(~keys_in_order(F.col("e")), keys)
    spread = record.select("id", *keep, "source", of_record.alias("of_record"), F.posexplode(F.concat(F.array(F.lit(None).cast("struct<key:string,value:string>")), F.col("e"))).alias("pos", "s"))

    def of(t: Column) -> Column:
        key = F.col("s.key")
        return F.array(
            F.when(too_short(t), found("short", key, F.concat(key, F.lit(SHORT), t))),
            F.when(leaks_instruction(t), found("leak", key, F.concat(key, F.lit(LEAK), F.substring(t, 1, 160)))),
            F.when(~ends_finished(t), found("punctuation", key, F.concat(key, F.lit(PUNCTUATION), F.right(t, F.lit(80))))),
            F.when(F.col("source").isNotNull() & ~F.contains(F.col("source"), comparable(t)), found("source", key, F.concat(key, F.lit(SOURCE)))),
        )

    every = F.when(F.col("pos") == 0, F.array("of_record")).otherwise(let(F.coalesce("s.value", F.lit("")), of))
    return spread.select("id", *keep, "pos", F.array_compact(every).alias("found"))


def problems(questions: DataFrame, statements: str = "statements", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, nth, check, key, message): one row for each problem; nth orders a record's problems by statement, and by check within one. keep: columns of questions that go along."""
    each = checked_units(questions, statements, keep).select("id", *keep, "pos", F.posexplode("found").alias("k", "p"))
    return each.select("id", *keep, (F.col("pos") * 4 + F.col("k")).alias("nth"), "p.check", "p.key", "p.message")


def gate(questions: DataFrame, statements: str = "statements", records: int = EXPECTED_RECORDS, total: int = EXPECTED_STATEMENTS) -> DataFrame:
    """One row, from one pass: counts, open problems (of records without an exemption), and the verdict by the first gate that fails."""
    exempt = F.coalesce(F.col("id").isin(*MANUAL_IDS, *FALSE_POSITIVE_IDS, *COSMETIC_IDS), F.lit(False))
    n = F.size("found").cast("long")
    sums = checked_units(questions, statements).agg(F.count_if(F.col("pos") == 0).alias("records"), F.count_if(F.col("pos") > 0).alias("statements"), F.coalesce(F.sum(n), F.lit(0)).alias("problems"), F.coalesce(F.sum(F.when(exempt, 0).otherwise(n)), F.lit(0)).alias("unexpected"))
    verdict = F.when(F.col("records") != records, "record count").when(F.col("statements") != total, "statement count").when(F.col("unexpected") > 0, "unexpected problems").otherwise("Validation passed.")
    return sums.withColumn("verdict", verdict)
