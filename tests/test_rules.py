"""Rule files in three formats, and rules with all operators, exceptions and defeaters against plain loops."""

import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veridane.operators import rules
from veridane.plans.evaluation import RULE_SCHEMA
from veridane.sources import files

# --- files -------------------------------------------------------------------

XML = """<?xml version='1.0'?>
<lr:Rules xmlns:r2='urn:x'>
  <!-- <lr:LegalRule key="dead"><if><Atom><Var>Z</Var><Ind>1</Ind></Atom></if><then><Atom><Ind>DENIED</Ind></Atom></then></lr:LegalRule> -->
  <r2:LegalRule key='a&amp;"b'>
    <r2:if><x9:And>
      <Atom><Rel iri='urn:is'/><Var> Z </Var><Ind><![CDATA[0]]></Ind></Atom>
      <And><Atom><Rel iri="urn:cmp#greaterThan"/><Var>X</Var><Ind>&#x31;</Ind></Atom><And><q:Atom><Var>W</Var><Ind>two words</Ind></q:Atom></And></And>
    </x9:And></r2:if>
    <then><Atom><Var>Y</Var><Ind>AWARDED</Ind></Atom></then>
    <hasStrength><Defeater iri="urn:rules/c"/><Defeater iri="urn:rules/noDefeater"/></hasStrength>
  </r2:LegalRule>
  <Rulebase><LegalRule key="c"><hasTemplate><Rule><if><Atom><Var>Z</Var><Ind>1</Ind></Atom></if><then><Atom><Ind>DENIED</Ind></Atom></then></Rule></hasTemplate></LegalRule></Rulebase>
</lr:Rules>"""


def loaded(reader, spark, tmp_path, text):
    path = tmp_path / "rules"
    path.write_text(text)
    return sorted((r["rule_id"], r["outcome"], [tuple(c) for c in r["conditions"]], [[tuple(c) for c in e] for e in r["exceptions"]], r["defeaters"]) for r in reader(spark, str(path)).collect())


def test_xml_is_read_by_a_parser(spark, tmp_path):
    got = loaded(files.rules_from_xml, spark, tmp_path, XML)
    assert got == [('a&"b', "AWARDED", [("Z", "eq", "0"), ("X", "gt", "1"), ("W", "eq", "two words")], [], ["c"]), ("c", "DENIED", [("Z", "eq", "1")], [], [])]


def rule_of(key='key="k"', test="<if><Atom><Var>Z</Var><Ind>1</Ind></Atom></if>", then="<then><Atom><Ind>DENIED</Ind></Atom></then>"):
    return f"<R><LegalRule {key}>{test}{then}</LegalRule></R>"


@pytest.mark.parametrize("text", [rule_of()[:-4], rule_of(key=""), rule_of(test=""), rule_of(test="<if><Or><Atom/></Or></if>"), rule_of(test="<if><Atom><Var>Z</Var></Atom></if>"), rule_of(then=""), rule_of(then="<then><Atom><Ind> </Ind></Atom></then>"), "no xml"])
def test_what_cannot_be_read_is_an_error(spark, tmp_path, text):
    with pytest.raises((PySparkException, Py4JJavaError)):
        loaded(files.rules_from_xml, spark, tmp_path, text)


def test_operands_of_policies(spark, tmp_path):
    item = lambda left, right, operator="eq": {"uid": "p", "constraint": [{"leftOperand": left, "operator": operator, "rightOperand": right}]}
    z = "http://x.org/substituteAvailable"
    rights = [0, "1", 2.5, True, {"@type": "http://www.w3.org/2001/XMLSchema#integer", "@value": "0"}, {"@value": 7}, {"@id": "http://x.org/y"}]
    got = loaded(files.rules_from_policy, spark, tmp_path, json.dumps({"permission": [item({"@id": z}, r, {"@id": "http://www.w3.org/ns/odrl/2/gteq"}) for r in rights]}, indent=1))
    assert [c for *_, cs, _, _ in got for c in cs] == [("Z", "gteq", v) for v in sorted(["0", "1", "2.5", "true", "0", "7", "http://x.org/y"])]
    assert loaded(files.rules_from_policy, spark, tmp_path, json.dumps({"prohibition": [item("urn:a:infringingProductAvailable", 1)]})) == [("p", "DENIED", [("X", "eq", "1")], [], [])]
    with pytest.raises((PySparkException, Py4JJavaError), match="unknown operand"):
        loaded(files.rules_from_policy, spark, tmp_path, json.dumps({"permission": [item("urn:other", 1)]}))


def test_units_with_exceptions(spark, tmp_path):
    unit = lambda action: {"rule_id": "u", "statement": {"action": action, "conditions": [{"field": "Z", "operator": "lt", "value": 3}], "exceptions": [{"conditions": [{"field": "X", "operator": "eq", "value": "a"}]}]}}
    assert loaded(files.rules_from_units, spark, tmp_path, json.dumps({"rule_units": [unit("award")]})) == [("u", "AWARDED", [("Z", "lt", "3")], [[("X", "eq", "a")]], [])]
    for bad in (json.dumps({"rule_units": [unit("suspend")]}), '{"rule_units": ['):
        with pytest.raises((PySparkException, Py4JJavaError)):
            loaded(files.rules_from_units, spark, tmp_path, bad)


# --- rules on facts ----------------------------------------------------------


def number(v):
    try:
        return float(v)
    except ValueError:
        return None


def holds(condition, fact):
    field, operator, want = condition
    have = fact[field]
    if have is None:
        return False
    a, b = number(str(have)), number(want)
    equal = a == b if a is not None and b is not None else str(have) == want
    if operator in ("eq", "neq", "ne"):
        return equal == (operator == "eq")
    return a is not None and {"lt": a < b, "lteq": a <= b, "lte": a <= b, "gt": a > b, "gteq": a >= b, "gte": a >= b}[operator]


def fired(table, fact):
    """Defeaters stand before those that they defeat in no particular order, so go on until nothing changes, from those without."""
    able = {r: all(holds(c, fact) for c in cs) and not any(all(holds(c, fact) for c in e) for e in es) for r, _, cs, es, _ in table}
    by, done = {r: d for r, *_, d in table}, {}

    def settled(r):
        if r not in done:
            done[r] = able.get(r, False) and not any(settled(d) for d in by.get(r, []))
        return done[r]

    return {r for r in by if settled(r)}


@pytest.mark.parametrize("most", [10_000, 60])
def test_rules_against_plain_loops(spark, most):
    r = random.Random(2)
    values = {"X": ["0", "1", "2.0", "-3"], "Z": ["0", "1", "10", "9"], "name": ["a", "b", "1", "01"]}

    def conditions(n):
        out = []
        for _ in range(n):
            f = r.choice(list(values))
            out.append((f, r.choice(["eq", "eq", "neq", "ne"] + (["lt", "lteq", "lte", "gt", "gteq", "gte"] if f != "name" else [])), r.choice(values[f])))
        return out

    table = [(f"r{k}", "o", conditions(r.randint(0, 3)), [conditions(r.randint(1, 2)) for _ in range(r.choice([0, 0, 1, 2]))], [f"r{j}" for j in range(k) if r.random() < 0.08] + (["nowhere"] if k == 3 else [])) for k in range(25)]
    facts = [(k, r.choice([None, 0, 1, 2, -3]), r.choice([None, 0.0, 1.0, 9.0, 9.5, 10.0]), r.choice([None, "a", "b", "1", "1.0", "c"])) for k in range(120)]
    got = rules.apply_rules(spark.createDataFrame(facts, "k int, X int, Z double, name string"), spark.createDataFrame([("d", *x) for x in table], RULE_SCHEMA), ("X", "Z", "name"), most)
    want = {(k, x) for k, a, b, c in facts for x in fired(table, {"X": a, "Z": b, "name": c})}
    assert {(row["k"], row["rule_id"]) for row in got.collect()} == want and got.count() == len(want) > 300


def one_rule(spark, conditions, rule_id="r", outcome="o", defeaters=()):
    return spark.createDataFrame([("d", rule_id, outcome, conditions, [], list(defeaters))], RULE_SCHEMA)


@pytest.mark.parametrize(("conditions", "rule_id", "outcome"), [([("X", "like", "1")], "r", "o"), ([("W", "eq", "1")], "r", "o"), ([("X", "eq", None)], "r", "o"), ([("X", "lt", "a")], "r", "o"), ([(None, "eq", "1")], "r", "o"), (None, "r", "o"), ([], "", "o"), ([], "r", ""), ([], "r", None)])
def test_no_rule_is_left_out_silently(spark, conditions, rule_id, outcome):
    facts = spark.createDataFrame([(1, 1)], "X int, Z int")
    with pytest.raises((PySparkException, Py4JJavaError), match="can't be judged|without an id"):
        rules.apply_rules(facts, one_rule(spark, conditions, rule_id, outcome)).collect()


def test_circles_of_defeaters(spark):
    a, b = one_rule(spark, [], "a", defeaters=["b"]), one_rule(spark, [], "b", defeaters=["a"])
    with pytest.raises(ValueError, match="circle"):
        rules.apply_rules(spark.createDataFrame([(1, 1)], "X int, Z int"), a.union(b))


def test_rules_without_conditions_and_empty_facts(spark):
    none = one_rule(spark, [])
    assert rules.apply_rules(spark.createDataFrame([(None, None), (1, 0)], "X int, Z int"), none).count() == 2
    assert rules.apply_rules(spark.createDataFrame([], "X int, Z int"), none).count() == 0
    assert rules.apply_rules(spark.createDataFrame([(1, 0)], "X int, Z int"), none.limit(0)).count() == 0


@pytest.mark.parametrize("most", [10_000, 2])
def test_states_with_one_value_in_common_are_dealt(spark, most, monkeypatch):
    """A field of one value, and comparisons of another one, over many states: no task gets them all, and few and many rules give the same."""
    monkeypatch.setattr(rules, "PAIRS", 1 << 12, raising=False)
    n, parts = 20_000, 16
    conf = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.enabled": "false"}
    had = {k: spark.conf.get(k, None) for k in conf}
    store = spark.sparkContext._jsc.sc().statusStore()
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        since = max((int(j.jobId()) for j in py(spark, store.jobsList(None))), default=-1)
        conditions = [[("f", "eq", "same"), ("x", "lt", "5000")], [("x", "gteq", "5000"), ("f", "neq", "other")], [("f", "eq", "other")], [("x", "eq", "7.0")]]
        ruled = spark.createDataFrame([("d", f"r{k}", "o", c) for k, c in enumerate(conditions)], "dsl string, rule_id string, outcome string, conditions array<struct<field:string,operator:string,value:string>>")
        facts = spark.range(0, n, 1, 8).select(F.col("id").alias("x"), F.lit("same").alias("f"))
        got = rules.apply_rules(facts, ruled, ("x", "f"), most).groupBy("rule_id").agg(F.count("*").alias("n"), F.sum("x").alias("s")).collect()
        assert {r["rule_id"]: (r["n"], r["s"]) for r in got} == {"r0": (5000, sum(range(5000))), "r1": (n - 5000, sum(range(5000, n))), "r3": (1, 7)}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = {i for j in py(spark, store.jobsList(None)) if int(j.jobId()) > since for i in py(spark, j.stageIds())}
        read = [t.taskMetrics().get().shuffleReadMetrics().recordsRead() for i in stages for t in py(spark, store.taskList(i, 0, 100_000)) if t.taskMetrics().isDefined()]
        assert max(read) < n / 2
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def py(spark, items):
    """A Scala sequence as a list."""
    return [items.apply(k) for k in range(items.size())]
