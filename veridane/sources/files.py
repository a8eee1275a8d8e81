"""Sources and sinks: question records, rule files in three formats, text files, cleaned sets, vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statements stay a map: a struct would lose their order, their number and null against empty.
QUESTION = "id STRING, year INT, problem_idx INT, objective STRING, domain STRING, category STRING, answer STRING, original_question STRING, statements MAP<STRING,STRING>, original_rationale STRING"

#: A rule's conditions.
CONDITIONS = "array<struct<field:string,operator:string,value:string>>"
#: What the actions of rule units decide, and the variables of operands' addresses.
ACTIONS = {"award": "AWARDED", "deny": "DENIED"}
VARIABLES = {"substituteAvailable": "Z", "infringingProductAvailable": "X"}
#: Fixed value: the defeater of rules that nothing defeats.
NO_DEFEATER = "noDefeater"


def read_questions(spark: SparkSession, path: str, lines: bool = False, position: bool = False) -> DataFrame:
    """A JSON array of records, indented or not, or JSON lines; malformed input is an error. Statements become ordered entries (key, value). On demand with `position`, by which records sort as they stand in the files."""
    raw = spark.read.schema(QUESTION).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    columns = [*raw.columns]
    if position:
        at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        raw = raw.select(*columns, at.alias("position"))
    return raw.withColumn("statements", F.map_entries("statements"))


#: Characters of one indented JSON array; a larger set is several arrays, each in a file of its own.
ARRAY = 32 << 20


def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of one JSON array of a task's records, (value): brackets around them, commas between them."""
    held = "["
    for batch in batches:
        lines = []
        for text in batch.column("value").to_pylist():
            lines.append(held if held == "[" else held + ",")
            held = text
        yield pa.record_batch([pa.array(lines, pa.string())], names=["value"])
    if held != "[":
        yield pa.record_batch([pa.array([held, "]"], pa.string())], names=["value"])


def write_questions(questions: DataFrame, path: str, one_array: bool = False) -> None:
    """Statements as a map in their order; JSON lines, or, as small tools write it, one indented JSON array in one file. A set of over `ARRAY` characters becomes one array a file, files by name in the order of the records, so no task has the whole."""
    as_map = questions.withColumn("statements", F.map_from_entries("statements"))
    if not one_array:
        as_map.write.mode("overwrite").json(path)
        return
    # One row a record; the array's brackets and commas stand around them. Null fields are written as null.
    keep_nulls = {"pretty": "true", "ignoreNullFields": "false"}
    text = F.regexp_replace(F.to_json(F.struct(*as_map.columns), keep_nulls), "(?m)^", "  ")
    rows = as_map.select(text.alias("value"), F.monotonically_increasing_id().alias("at"))
    length = rows.agg(F.sum(F.length("value"))).first()[0]
    if length is None:
        questions.sparkSession.range(1).select(F.lit("[\n\n]").alias("value")).coalesce(1).write.mode("overwrite").text(path)
        return
    # The records alone are shuffled, so what they are made from is read by as many tasks as it has parts.
    dealt = rows.repartitionByRange(-(-length // ARRAY), "at").sortWithinPartitions("at")
    dealt.mapInArrow(bracketed, "value string").write.mode("overwrite").text(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): a whole text file in a row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def wrong(what: Column, kind: str = "string") -> Column:
    return F.raise_error(what).cast(kind)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document, indented or not; malformed input is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def rules_from_units(spark: SparkSession, path: str) -> DataFrame:
    """Rule units (JSON with rule_units[].statement) as (dsl, rule_id, outcome, conditions, exceptions, defeaters). An exception is a list of conditions, by itself or as an object's `conditions`; an unknown action is an error."""
    condition = "STRUCT<field:STRING,operator:STRING,value:STRING>"
    schema = f"rule_units ARRAY<STRUCT<rule_id:STRING,statement:STRUCT<action:STRING,conditions:ARRAY<{condition}>,exceptions:ARRAY<STRUCT<conditions:ARRAY<{condition}>>>>>>"
    units = read_json(spark, path, schema).select(F.explode("rule_units").alias("u"))
    outcome = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), F.col("u.statement.action")), wrong(F.concat(F.lit("unknown action of rule "), F.coalesce("u.rule_id", F.lit("?")))))
    exceptions = F.coalesce(F.transform("u.statement.exceptions", lambda e: e["conditions"]), F.array().cast(f"array<{CONDITIONS}>"))
    return units.select(F.lit("de_jure").alias("dsl"), F.col("u.rule_id").alias("rule_id"), outcome.alias("outcome"), F.col("u.statement.conditions").alias("conditions"), exceptions.alias("exceptions"), F.array().cast("array<string>").alias("defeaters"))


def definitions_from_units(spark: SparkSession, path: str) -> DataFrame:
    """(term, text, scope) of a rule-unit file's definitions."""
    schema = "definitions ARRAY<STRUCT<term:STRING,text:STRING,scope:STRING>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("definitions"))


def section_from_units(spark: SparkSession, path: str) -> DataFrame:
    """(citation, title, effective_dates, notes) of a rule-unit file, one row."""
    schema = "section_metadata STRUCT<citation:STRING,title:STRING,effective_dates:STRING,notes:STRING>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("section_metadata.*")


def operand_text(operand: Column) -> Column:
    """The value of a JSON operand: a plain one, or a typed one's @value (or its address, @id)."""
    typed = lambda key: F.try_variant_get(operand, f"$['{key}']", "string")
    return F.when(F.startswith(F.schema_of_variant(operand), F.lit("OBJECT")), F.coalesce(typed("@value"), typed("@id"))).otherwise(F.try_variant_get(operand, "$", "string"))


def rules_from_policy(spark: SparkSession, path: str) -> DataFrame:
    """A policy (JSON with permission[] and prohibition[]) as (dsl, rule_id, outcome, conditions, exceptions, defeaters): a permission awards, a prohibition denies. Operands are plain or typed; an unknown one is an error."""
    item = "ARRAY<STRUCT<uid:STRING,constraint:ARRAY<STRUCT<leftOperand:VARIANT,operator:VARIANT,rightOperand:VARIANT>>>>"
    policy = read_json(spark, path, f"permission {item}, prohibition {item}")
    parts = [policy.select(F.explode(kind).alias("r"), F.lit(label).alias("outcome")) for kind, label in (("permission", "AWARDED"), ("prohibition", "DENIED"))]
    names = F.create_map(*[F.lit(x) for kv in VARIABLES.items() for x in kv])

    def condition(c: Column) -> Column:
        last = lambda x: F.regexp_extract(operand_text(x), r"([^/#:]*)\z", 1)
        field = F.coalesce(F.try_element_at(names, last(c["leftOperand"])), wrong(F.concat(F.lit("unknown operand of rule "), F.coalesce("r.uid", F.lit("?")))))
        return F.struct(field.alias("field"), last(c["operator"]).alias("operator"), operand_text(c["rightOperand"]).alias("value"))

    return parts[0].union(parts[1]).select(F.lit("odrl").alias("dsl"), F.col("r.uid").alias("rule_id"), "outcome", F.transform("r.constraint", condition).alias("conditions"), F.array().cast(f"array<{CONDITIONS}>").alias("exceptions"), F.array().cast("array<string>").alias("defeaters"))


#: Relations of atoms that are no equality, by the end of their address.
RELATIONS = {"lessThan": "lt", "lessThanOrEqual": "lteq", "greaterThan": "gt", "greaterThanOrEqual": "gteq", "notEqual": "neq"}


def rules_from_xml(spark: SparkSession, path: str) -> DataFrame:
    """Legal rules in XML (LegalRule: if Atom (Rel, Var, Ind) or And, also nested, then Atom) as (dsl, rule_id, outcome, conditions, exceptions, defeaters).

    The parser is Spark's: comments, CDATA, entities and either quotes are what XML
    says; prefixes of names don't matter and need no declaration. Malformed XML, and a
    rule without a key, an outcome or an atom that can be read, are errors.
    """
    atom = "Atom ARRAY<STRUCT<Rel:STRUCT<_iri:STRING>,Var:STRING,Ind:STRING>>"
    test = f"{atom}, And ARRAY<STRUCT<{atom}, And ARRAY<STRUCT<{atom}, And ARRAY<STRUCT<{atom}>>>>>>".replace("Atom ARRAY", "Atom:ARRAY").replace("And ARRAY", "And:ARRAY")
    rule = f"`if`:STRUCT<{test}>,`then`:STRUCT<{atom.replace('Atom ARRAY', 'Atom:ARRAY')}>"
    legal = f"ARRAY<STRUCT<_key:STRING,{rule},hasTemplate:STRUCT<Rule:STRUCT<{rule}>>,hasStrength:STRUCT<Defeater:ARRAY<STRUCT<_iri:STRING>>>>>"
    schema = f"LegalRule {legal}, Rulebase ARRAY<STRUCT<LegalRule:{legal}>>, _corrupt_record STRING"
    parsed = spark.read.text(path, wholetext=True).select(F.from_xml("value", schema, {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("x"))
    none = F.array().cast(legal)
    every = F.concat(F.coalesce("x.LegalRule", none), F.coalesce(F.flatten(F.transform("x.Rulebase", lambda b: F.coalesce(b["LegalRule"], none))), none))
    sound = F.when(F.col("x._corrupt_record").isNull(), every).otherwise(wrong(F.lit("not well-formed XML"), legal))
    rules = parsed.select(F.explode(sound).alias("r")).select(F.col("r._key").alias("key"), F.coalesce("r.hasTemplate.Rule.if", "r.if").alias("test"), F.coalesce("r.hasTemplate.Rule.then", "r.then").alias("then"), "r.hasStrength")

    atoms_type = atom.removeprefix("Atom ")

    def atoms(node: Column, depth: int) -> Column:
        own = F.coalesce(node["Atom"], F.array().cast(atoms_type))
        return F.concat(own, F.coalesce(F.flatten(F.transform(node["And"], lambda n: atoms(n, depth - 1))), F.array().cast(atoms_type))) if depth else own

    text = lambda c: F.nullif(F.trim(c, F.lit(" \t\r\n")), F.lit(""))
    relations = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])
    unread = F.concat(F.lit("a legal rule that can't be read: "), F.coalesce("key", F.lit("?")))

    def condition(a: Column) -> Column:
        relation = F.coalesce(F.try_element_at(relations, F.regexp_extract(F.coalesce(a["Rel"]["_iri"], F.lit("")), r"([^/#:]*)\z", 1)), F.lit("eq"))
        return F.struct(F.coalesce(text(a["Var"]), wrong(unread)).alias("field"), relation.alias("operator"), F.coalesce(text(a["Ind"]), wrong(unread)).alias("value"))

    found = F.transform(atoms(F.col("test"), 3), condition)
    conditions = F.when(F.col("test").isNotNull() & (F.size(atoms(F.col("test"), 3)) > 0), found).otherwise(wrong(unread, CONDITIONS))
    outcome = F.coalesce(text(F.get("then.Atom", F.lit(0))["Ind"]), wrong(unread))
    ends = F.transform("hasStrength.Defeater", lambda d: F.regexp_extract(d["_iri"], r"([^/#:]*)\z", 1))
    defeaters = F.coalesce(F.filter(ends, lambda d: (d != NO_DEFEATER) & (d != "")), F.array().cast("array<string>"))
    return rules.select(F.lit("legalruleml").alias("dsl"), F.coalesce(text(F.col("key")), wrong(unread)).alias("rule_id"), outcome.alias("outcome"), conditions.alias("conditions"), F.array().cast(f"array<{CONDITIONS}>").alias("exceptions"), defeaters.alias("defeaters"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """vectors (vec_id, vector) as Parquet, vectors as arrays of floats."""
    vectors.select(F.col("vec_id").cast("string").alias("vec_id"), F.col("vector").cast("array<float>").alias("vector")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vec_id string, vector array<float>").parquet(path)
