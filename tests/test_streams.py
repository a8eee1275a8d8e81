"""Streams in batches that come apart, with restarts, against the batch operators."""

import datetime
import json
import random

from pyspark.sql import functions as F

from veridane.__main__ import main
from veridane.operators import clean, score, validate
from veridane.streaming import live

RESPONSE = "model string, pair_id long, side string, expected string, decision string, at timestamp"


def ended(query):
    assert query.awaitTermination(120) and query.exception() is None


def bag(df):
    return sorted(map(repr, df.collect()))


def test_pairs_whose_sides_arrive_apart(spark, tmp_path):
    r = random.Random(1)
    start, label = datetime.datetime(2024, 1, 1), lambda: r.choice(["AWARDED", "DENIED"])
    rows = [(f"m{k % 3}", k, s, label(), r.choice([label(), None]), start + datetime.timedelta(minutes=k)) for k in range(60) for s in "AB"]
    r.shuffle(rows)
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in (rows[:50], rows[50:]):
        spark.createDataFrame(part, RESPONSE).coalesce(1).write.mode("append").parquet(source)
        ended(live.pair_stream(spark, source, target, state))
    got, batch = spark.read.schema(live.PAIR).parquet(target), spark.createDataFrame(rows, RESPONSE)
    assert bag(got.select("model", "pair_id", "sides", "passed")) == bag(score.pair_score(batch))
    assert bag(score.violations_of(got)) == bag(score.violation_score(batch.withColumn("parse_ok", F.lit(True))))
    known = {(x["model"], x["pair_id"]): x["flipped"] for x in score.flips(batch).collect() if x["flipped"] is not None}
    assert {(x["model"], x["pair_id"]): x["flipped"] for x in got.filter("flipped IS NOT NULL").collect()} == known


def test_a_side_that_stays_alone_is_scored_late(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    day = lambda d: datetime.datetime(2024, 1, d)
    for part in ([("m", 1, "A", "AWARDED", "AWARDED", day(1))], [("m", 2, "A", "DENIED", "DENIED", day(9))], [("m", 2, "B", "AWARDED", "DENIED", day(9))]):
        spark.createDataFrame(part, RESPONSE).coalesce(1).write.mode("append").parquet(source)
        ended(live.pair_stream(spark, source, target, state))
    got = {(x["pair_id"], x["sides"], x["passed"], x["flipped"]) for x in spark.read.parquet(target).collect()}
    assert got == {(1, 1, True, None), (2, 2, False, False)}


def test_clean_and_validate_on_a_stream(spark, tmp_path):
    entries = "array<struct<key:string,value:string>>"
    schema = f"id string, original_question string, statements {entries}"
    good = "This statement is long enough."
    parts = [[("2023_29", f"<statements> (a) {good} (b) {good} <choices> x", [("statement_1", "x")]), ("2025_05", "", None)], [("zz", "q", [("statement_2", "short"), ("statement_1", good)])]]
    source = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        for name, start in (("clean", live.clean_stream), ("validate", live.validate_stream)):
            ended(start(spark, source, str(tmp_path / name), str(tmp_path / f"{name}-state"), schema))
    whole = spark.createDataFrame([x for p in parts for x in p], schema)
    for name, want in (("clean", clean.clean(whole)), ("validate", validate.problems(whole))):
        assert bag(spark.read.schema(want.schema).parquet(str(tmp_path / name))) == bag(want)


def test_reports_are_whole_and_in_the_files_order(spark, tmp_path, capsys):
    ids = random.Random(2).sample(range(10_000), 1500)
    (tmp_path / "q.json").write_text("\n".join(json.dumps({"id": f"q{i}", "original_question": "x", "statements": {"statement_1": "bad"}}) for i in ids))
    (tmp_path / "array.json").write_text(json.dumps([{"id": f"q{i}", "original_question": "x", "statements": None} for i in ids], indent=1))
    assert main(["validate", "--input", str(tmp_path / "q.json"), "--lines", "--report", str(tmp_path / "report")], spark) == 1
    lines = "".join(f.read_text() for f in sorted((tmp_path / "report").glob("part-*"))).splitlines()
    assert len(lines) == 4500 and [x.split(":")[0] for x in lines[::3]] == [f"q{i}" for i in ids]
    capsys.readouterr()
    assert main(["validate", "--input", str(tmp_path / "array.json")], spark) == 1
    assert [x for x in capsys.readouterr().out.splitlines() if x.startswith("q")] == [f"q{i}: missing statements" for i in ids]
