"""Command line: clean and validate question sets, decide responses, print prompts."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridane.operators import clean, extract, prompt, validate
from veridane.sources import files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="veridane")
    commands = out.add_subparsers(dest="command", required=True)
    c = commands.add_parser("clean", help="clean a question set and report what changed")
    c.add_argument("--input", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--array", action="store_true", help="write one JSON array, for small sets, instead of JSON lines")
    c.add_argument("--lines", action="store_true", help="the input is JSON lines")
    c.add_argument("--report", help="write changes and warnings there instead of printing them")
    v = commands.add_parser("validate", help="list problems of a question set; exit 1 unless it passes")
    v.add_argument("--input", required=True)
    v.add_argument("--lines", action="store_true", help="the input is JSON lines")
    v.add_argument("--report", help="write problems there instead of printing them")
    v.add_argument("--records", type=int, default=validate.EXPECTED_RECORDS)
    v.add_argument("--statements", type=int, default=validate.EXPECTED_STATEMENTS)
    d = commands.add_parser("decide", help="decide responses (Parquet with a column raw)")
    d.add_argument("--input", required=True)
    d.add_argument("--output", required=True)
    p = commands.add_parser("prompt", help="print the system prompt of a rule language")
    p.add_argument("--dsl", choices=list(prompt.DISPLAY), default="plain")
    return out


def report(lines: DataFrame, path: str | None) -> None:
    """All lines (position, nth, line) in the order of the input's records: printed, one partition at a time, or, by ranges of that order, written to files in the order of their names."""
    ordered = lines.orderBy("position", "nth").select("line")
    if path:
        ordered.write.mode("overwrite").text(path)
    else:
        for row in ordered.toLocalIterator():
            print(row["line"])


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("veridane").getOrCreate()
    if a.command == "clean":
        done = clean.clean(files.read_questions(spark, a.input, a.lines, position=True))
        out = done.withColumn("statements", F.col("new_statements")).drop("mode", "new_statements", "logged", "warning", "position")
        files.write_questions(out, a.output, a.array)
        told = clean.change_log(done, ("position",)).select("position", F.lit(0).alias("nth"), F.concat_ws(" ", "id", F.concat(F.col("old_count").cast("string"), F.lit(" ->")), F.col("new_count").cast("string"), "mode").alias("line"))
        warned = done.filter("warning IS NOT NULL").select("position", F.lit(1).alias("nth"), F.concat_ws(" ", F.col("id"), F.lit("warning:"), F.col("warning")).alias("line"))
        report(told.union(warned), a.report)
        clean.totals(done).show(truncate=False)
    elif a.command == "validate":
        questions = files.read_questions(spark, a.input, a.lines, position=True)
        report(validate.problems(questions, keep=("position",)).select("position", "nth", F.concat_ws(": ", "id", "message").alias("line")), a.report)
        verdict = validate.gate(questions, records=a.records, total=a.statements).first()
        print(verdict["verdict"])
        return 0 if verdict["verdict"] == "Validation passed." else 1
    elif a.command == "decide":
        extract.decide(spark.read.parquet(a.input)).write.mode("overwrite").parquet(a.output)
    else:
        print(prompt.shipped_prompts(spark).filter(F.col("dsl") == a.dsl).first()["system"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
