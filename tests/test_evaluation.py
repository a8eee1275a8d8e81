"""Extraction, rules, prompts, sources, streaming."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veridane.operators import extract, prompt, rules
from veridane.plans.evaluation import EDGES
from veridane.sources import files
from veridane.streaming import live


#: Texts and the objects in them, written by hand.
OBJECTS = (
    ("{}{}", ["{}", "{}"]),
    ('a "{" {b} " {c}', ["{b}"]),
    ('{"a": "\\\\"} {"b": "\\""}', ['{"a": "\\\\"}', '{"b": "\\""}']),
    ("}}{{}", []),
    ("}}{{}}{x}", ["{{}}", "{x}"]),
    ("{😀} x", ["{😀}"]),
    ("", []),
    ("no braces", []),
    ('A 6" bolt: {"x": 1}', []),
    ('two "quotes" {"x": {"y": "}"}} end', ['{"x": {"y": "}"}}']),
    ('\\"{a} {b}', []),
    ('{"line\nend": "\\', []),
    ("{a\nb}\n{c}", ["{a\nb}", "{c}"]),
)


def test_object_scanner(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(OBJECTS)], "k int, t string")
    got = {r["k"]: r["o"] for r in df.select("k", extract.json_objects(F.col("t")).alias("o")).collect()}
    assert got == {k: o for k, (_, o) in enumerate(OBJECTS)}


def test_many_objects_in_one_response(spark):
    """20,000 objects, nested ones and stray braces in between."""
    text = 'so {"a": {"b": "}"}} } "{" ' * 20000
    df = spark.createDataFrame([(text,)], "t string").select(extract.json_objects(F.col("t")).alias("o"))
    r = df.select(F.size("o").alias("n"), F.size(F.array_distinct("o")).alias("kinds"), F.get("o", F.lit(19999)).alias("last")).first()
    assert (r["n"], r["kinds"], r["last"]) == (20000, 1, '{"a": {"b": "}"}}')


def test_null_response_fails_closed(spark):
    r = extract.decide(spark.createDataFrame([(None,)], "raw string")).first()
    assert (r["decision"], r["parse_ok"]) == ("DENIED", False)


def test_prompt(spark, tmp_path):
    df = spark.createDataFrame([("ODRL", "r1 {dsl_name}"), ("plain", "r2")], "d string, r string")
    odrl, plain = [r["p"] for r in df.select(prompt.system_prompt(F.col("d"), F.col("r")).alias("p")).collect()]
    assert "<ODRL>\nr1 {dsl_name}\n</ODRL>" in odrl and "the ODRL rules" in odrl and "the plain English rules" in plain and "r2" not in plain
    assert df.select(prompt.default_prompt().alias("p")).first()["p"] == plain
    with pytest.raises(PySparkException, match="Unsupported DSL"):
        df.select(prompt.system_prompt(F.lit("nope"), F.col("r")).alias("p")).collect()
    texts = {"base": "B {dsl_section}\n\n{dsl_name}.\n", "plain": "inline", "odrl": "<{rules}>", "legalruleml": "", "de_jure": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    own = prompt.read_templates(spark, {name: str(tmp_path / name) for name in texts})
    assert df.select(prompt.system_prompt(F.col("d"), F.col("r"), own).alias("p")).collect()[0]["p"] == "B <r1 {dsl_name}>\n\nODRL."


def test_rule_files_agree(spark):
    loaded = rules.shipped_rules(spark)
    conditions = lambda r: sorted((c["field"], c["operator"], c["value"]) for c in r["conditions"])
    shape = {dsl: sorted((r["outcome"], conditions(r)) for r in loaded.filter(F.col("dsl") == dsl).collect()) for dsl in ("de_jure", "odrl", "legalruleml")}
    assert shape["de_jure"] == shape["odrl"] == shape["legalruleml"] == [("AWARDED", [("X", "eq", "1"), ("Z", "eq", "0")]), ("DENIED", [("X", "eq", "0"), ("Z", "eq", "0")]), ("DENIED", [("Z", "eq", "1")])]


def test_definitions(spark, tmp_path):
    about = {"citation": "c", "title": "t", "effective_dates": "now", "notes": "n"}
    (tmp_path / "u.json").write_text(json.dumps({"section_metadata": about, "definitions": [{"term": "X", "text": "a thing", "scope": "all"}, {"term": "Z"}]}, indent=2))
    assert [tuple(r) for r in files.definitions_from_units(spark, str(tmp_path / "u.json")).collect()] == [("X", "a thing", "all"), ("Z", None, None)]
    assert files.section_from_units(spark, str(tmp_path / "u.json")).first().asDict() == about
    assert files.rules_from_units(spark, str(tmp_path / "u.json")).count() == 0


def test_question_files(spark, tmp_path):
    data = [{"id": "a", "answer": "1", "original_question": "q", "statements": {"statement_2": "x", "statement_1": "y"}}, {"id": "b", "answer": "2", "statements": None}]
    (tmp_path / "q.json").write_text(json.dumps(data, indent=2))
    q = files.read_questions(spark, str(tmp_path / "q.json"))
    rows = {r["id"]: r["statements"] for r in q.collect()}
    assert [e["key"] for e in rows["a"]] == ["statement_2", "statement_1"] and rows["b"] is None
    files.write_questions(q, str(tmp_path / "out"))
    assert {r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()} == {"a", "b"}
    files.write_questions(q, str(tmp_path / "one"), one_array=True)
    assert files.read_questions(spark, str(tmp_path / "one")).orderBy("id").collect() == q.orderBy("id").collect()
    lines = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "one"), wholetext=True).collect())
    assert [r["id"] for r in json.loads(lines)] == ["a", "b"] and lines.startswith("[\n  {\n")
    (tmp_path / "bad.json").write_text('[{"id": ')
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_questions(spark, str(tmp_path / "bad.json")).collect()


def test_array_files_of_many_tasks(spark, tmp_path, monkeypatch):
    """The records' own tasks stay as many as they are, a small set is one array, a large one is several in order, none is an empty one."""
    made = spark.range(0, 40, 1, 4).select(F.concat(F.spark_partition_id(), F.lit("-"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("id"), F.array().cast("array<struct<key:string,value:string>>").alias("statements"))
    ids = [r["id"] for r in made.collect()]
    assert {i[0] for i in ids} == set("0123")
    texts = lambda name: [p.read_text() for p in sorted((tmp_path / name).glob("part-*"))]
    files.write_questions(made, str(tmp_path / "small"), one_array=True)
    assert [[r["id"] for r in json.loads(t)] for t in texts("small")] == [ids]
    monkeypatch.setattr(files, "ARRAY", 400)
    files.write_questions(made, str(tmp_path / "large"), one_array=True)
    arrays = [json.loads(t) for t in texts("large")]
    assert len(arrays) > 3 and [r["id"] for a in arrays for r in a] == ids
    assert sorted(r["id"] for r in files.read_questions(spark, str(tmp_path / "large")).collect()) == ids
    files.write_questions(made.filter("id = ''"), str(tmp_path / "none"), one_array=True)
    assert [json.loads(t) for t in texts("none")] == [[]] and files.read_questions(spark, str(tmp_path / "none")).count() == 0


def test_vectors_round_trip(spark, tmp_path):
    files.write_vectors(spark.createDataFrame([("v", [1.0, -2.5])], "vec_id string, vector array<double>"), str(tmp_path / "v"))
    assert files.read_vectors(spark, str(tmp_path / "v")).first()["vector"] == [1.0, -2.5]


def test_decisions_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(k, r) for k, (r, *_) in enumerate(EDGES)], "k int, raw string").write.parquet(str(tmp_path / "in"))
    q = live.decide_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "k int, raw string")
    q.awaitTermination(120)
    got = {r["k"]: (r["decision"], r["parse_ok"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {k: (d, ok) for k, (_, d, _, ok) in enumerate(EDGES)}
