"""The decision rule, in code and as data."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridane.sources import files
from veridane.sources.scratch import shipped, stored

AWARDED, DENIED = "AWARDED", "DENIED"
RULE = ["dsl", "rule_id", "outcome"]

#: Explanations of the three outcomes.
SUBSTITUTE = "A non-infringing substitute is available, so the claim is denied"
GRANTED = "No substitute is available and the infringing product is present, so the claim is awarded"
ABSENT = "The infringing product is absent, so the claim is denied"


def decision(infringing: Column, substitute: Column) -> Column:
    """STRUCT(decision, explanation): a substitute denies, else an infringing product awards, else denied."""

    def out(label: str, why: str) -> Column:
        return F.named_struct(F.lit("decision"), F.lit(label), F.lit("explanation"), F.lit(why))

    return F.when(substitute, out(DENIED, SUBSTITUTE)).when(infringing, out(AWARDED, GRANTED)).otherwise(out(DENIED, ABSENT))


#: The package's own rules, read once an application.
_READ: dict[str, list] = {}


def shipped_rules(spark: SparkSession) -> DataFrame:
    """(dsl, rule_id, outcome, conditions, exceptions, defeaters) of the package's rule files, each read in its own format."""
    key = spark.sparkContext.applicationId
    if key not in _READ:
        at = lambda name: shipped(spark, "veridane.rulesets", name)
        units, policy, xml = files.rules_from_units(spark, at("units.json")), files.rules_from_policy(spark, at("policy.json")), files.rules_from_xml(spark, at("rules.xml"))
        _READ[key] = units.union(policy).union(xml).collect()
    condition = pa.list_(pa.struct([(n, pa.string()) for n in ("field", "operator", "value")]))
    schema = pa.schema([*[(n, pa.string()) for n in RULE], ("conditions", condition), ("exceptions", pa.list_(condition)), ("defeaters", pa.list_(pa.string()))])
    return spark.createDataFrame(pa.Table.from_pylist([r.asDict(recursive=True) for r in _READ[key]], schema))


#: Pairs of states and parts of rules that one task counts. Copies of over `most` conditions, which states are dealt over.
PAIRS, SALTS = 1 << 20, 32

#: Comparisons of a condition; the first of each are the names used.
OPERATORS = {"eq": "eq", "neq": "neq", "ne": "neq", "lt": "lt", "lteq": "lteq", "lte": "lteq", "gt": "gt", "gteq": "gteq", "gte": "gteq"}
ORDER = {"lt": lambda a, b: a < b, "lteq": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gteq": lambda a, b: a >= b}


def canonical(value: Column) -> Column:
    """Numbers, however written, as one text; other values as they are."""
    text = value.cast("string")
    return F.coalesce(text.try_cast("double").cast("string"), text)


def parts_of(rules: DataFrame) -> DataFrame:
    """(dsl, rule_id, outcome, part, conditions): a row for a rule's own conditions (part 0) and one for each of its exceptions (from 1)."""
    none = F.array().cast("array<array<struct<field:string,operator:string,value:string>>>")
    own = F.array(F.col("conditions").cast("array<struct<field:string,operator:string,value:string>>"))
    exceptions = F.coalesce(F.col("exceptions").cast("array<array<struct<field:string,operator:string,value:string>>>"), none) if "exceptions" in rules.columns else none
    return rules.select(*RULE, F.posexplode(F.concat(own, exceptions)).alias("part", "conditions"))


def checked(parts: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """parts with operators under one name each; what can't be judged, by its operator, field or value, is an error, so no rule is left out."""
    name = F.create_map(*[F.lit(x) for kv in OPERATORS.items() for x in kv])

    def one(c: Column) -> Column:
        operator = F.try_element_at(name, F.coalesce(c["operator"], F.lit("")))
        ordered = operator.isin(*ORDER)
        good = operator.isNotNull() & F.coalesce(c["field"].isin(*fields), F.lit(False)) & c["value"].isNotNull() & (~ordered | c["value"].try_cast("double").isNotNull())
        wrong = F.raise_error(F.concat(F.lit("rule "), F.col("rule_id"), F.lit(" has a condition that can't be judged: "), F.to_json(c))).cast("string")
        return F.struct(c["field"].alias("field"), F.when(good, operator).otherwise(wrong).alias("operator"), canonical(c["value"]).alias("value"))

    missing = F.raise_error(F.concat(F.lit("a rule without an id, an outcome or readable conditions: "), F.coalesce("rule_id", F.lit("?")))).cast("array<struct<field:string,operator:string,value:string>>")
    whole = F.col("rule_id").isNotNull() & (F.col("rule_id") != "") & F.col("outcome").isNotNull() & (F.col("outcome") != "") & F.col("conditions").isNotNull()
    return parts.withColumn("conditions", F.when(whole, F.array_distinct(F.transform("conditions", one))).otherwise(missing))


def strata(rules: DataFrame, most: int) -> list[list[tuple[str, str, str]]]:
    """(dsl, rule_id, defeater) by level: a level's rules are defeated only by rules of lower ones. A circle is an error."""
    if "defeaters" not in rules.columns:
        return []
    edges = rules.select("dsl", "rule_id", F.explode("defeaters").alias("by")).limit(most + 1).collect()
    if len(edges) > most:
        raise ValueError(f"more than {most} defeaters")
    by: dict[tuple[str, str], set[tuple[str, str]]] = {}
    for e in edges:
        by.setdefault((e["dsl"], e["rule_id"]), set()).add((e["dsl"], e["by"]))
    out, settled = [], set()
    while len(settled) < len(by):
        level = {r for r, defeaters in by.items() if r not in settled and all(d in settled or d not in by for d in defeaters)}
        if not level:
            raise ValueError(f"rules defeat each other in a circle: {sorted(set(by) - settled)}")
        out.append(sorted((r[0], r[1], d[1]) for r in level for d in by[r]))
        settled |= level
    return out


def index_of(rules: DataFrame, fields: tuple[str, ...], most: int) -> tuple[DataFrame, list | None]:
    """A row for each condition of each part of a rule, one with nulls for a part without conditions; and these rows, if they are at most `most`. So few are read once, and stand in the plan as they are; more are written once."""
    parts = checked(parts_of(rules), fields).withColumn("size", F.size("conditions"))
    index = parts.select(*RULE, "part", "size", F.explode_outer("conditions").alias("c")).select(*RULE, "part", "size", "c.field", "c.operator", "c.value")
    head = index.limit(most + 1).collect()
    if len(head) > most:
        return stored(index, "rules"), None
    spark, names = rules.sparkSession, index.columns
    kinds = {"string": pa.string(), "int": pa.int32()}
    columns = [pa.array([row[k] for row in head], kinds[dict(index.dtypes)[name]]) for k, name in enumerate(names)]
    return spark.createDataFrame(pa.table(columns, names=names)), head


def apply_rules(facts: DataFrame, rules: DataFrame, fields: tuple[str, ...] = ("X", "Z"), most: int = 10_000) -> DataFrame:
    """facts joined to each rule that fires.

    A rule fires if all its conditions hold, unless all conditions of one of its
    exceptions do, or a rule that is among its defeaters fires. rules: (dsl, rule_id,
    outcome, conditions), and, if there are any, exceptions (lists of conditions) and
    defeaters (ids of rules of the same dsl). A null field makes no condition hold;
    a rule without conditions always holds; one that can't be judged is an error.

    Conditions are an index: equality is a hash join on (field, value), order a join on
    the field, both with the fields of each state of facts, row by row; a rule's
    conditions that a state meets are counted, and all must be there. Facts join their
    state's rules at the end, so what rules cost follows the number of states, not of
    facts. Up to `most` conditions (they are counted) go to every task; more are repeated
    `SALTS` times and states dealt over these, so no value or field is a group of its own.
    States have numbers, and a task counts about `PAIRS` pairs of states and rules.
    """
    state = F.struct(*[canonical(F.col(f)).alias(f) for f in fields])
    keyed = facts.withColumn("_of", state)
    states = stored(keyed.select("_of").distinct().withColumn("_state", F.monotonically_increasing_id()), "states")
    index, head = index_of(rules, fields, most)
    sent = F.broadcast if head is not None else lambda df: df
    # Of few rules it is known which joins they need.
    some = lambda test: head is None or any(test(r) for r in head)

    # A field's row for equality has its value as key, the one for other comparisons has none, so one join serves both.
    equal = lambda c: F.concat(F.lit("="), c)
    kinds = [lambda c: equal(c)] * some(lambda r: r["operator"] == "eq") + [lambda c: F.lit("")] * some(lambda r: r["operator"] not in ("eq", None))
    row = lambda f, key: F.struct(F.lit(f).alias("field"), F.col(f"_of.{f}").alias("v"), F.col(f"_of.{f}").try_cast("double").alias("x"), key(F.col(f"_of.{f}")).alias("key"))
    pairs = F.array(*[row(f, key) for f in fields for key in kinds or [equal]])
    parts = len({(r["dsl"], r["rule_id"], r["part"]) for r in head}) if head is not None else most
    n = states.count()
    dealt = states.repartition(max(1, min(n * parts // PAIRS, n // 1000) + 1), "_state")
    held = dealt.select("_state", F.inline(pairs)).filter("v IS NOT NULL")
    tests = index.filter("operator IS NOT NULL").withColumnRenamed("field", "f").withColumns({"y": F.col("value").try_cast("double"), "k": F.when(F.col("operator") == "eq", equal(F.col("value"))).otherwise("")})
    same = (F.col("field") == F.col("f")) & (F.col("key") == F.col("k"))
    if head is None:
        tests = tests.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same &= F.pmod(F.col("_state"), F.lit(SALTS)) == F.col("salt")
    ordered = functools.reduce(lambda c, kv: F.when(F.col("operator") == kv[0], kv[1](F.col("x"), F.col("y"))).otherwise(c), ORDER.items(), F.col("v") != F.col("value"))
    met = held.join(sent(tests), same & ((F.col("k") != "") | ordered))
    counted = met.groupBy("_state", *RULE, "part", "size").agg(F.count("*").alias("n")).filter("n = size")
    whole = counted.select("_state", *RULE, "part")
    if some(lambda r: r["size"] == 0):
        whole = whole.union(states.select("_state").join(sent(index.filter("size = 0").select(*RULE, "part")), F.lit(True)))
    levels, excepted = strata(rules, most), some(lambda r: r["part"] > 0)
    # What is read more than once is written once: plans stay short however many strata there are.
    if excepted:
        whole = stored(whole, "holding")
    out = whole.filter("part = 0").drop("part")
    if excepted:
        out = out.join(whole.filter("part > 0").select("_state", "dsl", "rule_id").distinct(), ["_state", "dsl", "rule_id"], "left_anti")
    if levels:
        out = stored(out, "firing")
    for level in levels:
        defeats = F.broadcast(facts.sparkSession.createDataFrame(level, "dsl string, beaten string, rule_id string"))
        beaten = out.join(defeats, ["dsl", "rule_id"]).select("_state", "dsl", F.col("beaten").alias("rule_id")).distinct()
        out = stored(out.join(beaten, ["_state", "dsl", "rule_id"], "left_anti"), "standing")
    return keyed.join(out.select("_state", *RULE).join(states, "_state").drop("_state"), "_of").drop("_of")
