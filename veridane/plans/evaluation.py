"""Queries of rule evaluation, extraction and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridane.operators import extract, grammar, prompt, rules, score
from veridane.plans.registry import register, table
from veridane.sources import files, scratch

CASE = "CASE WHEN toxic = 1 THEN 'DENIED' WHEN quality = 1 THEN 'AWARDED' ELSE 'DENIED' END"
WHY = f"CASE WHEN toxic = 1 THEN '{rules.SUBSTITUTE}' WHEN quality = 1 THEN '{rules.GRANTED}' ELSE '{rules.ABSENT}' END"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as facts: X from quality, Z from toxic."""
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("X"), F.col("toxic").cast("int").alias("Z"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rules.decision(F.col("X") == 1, F.col("Z") == 1)
    return facts(spark, sf_dir).select("doc_id", d["decision"].alias("decision"), d["explanation"].alias("explanation"))


register("rule_decision", f"SELECT doc_id, {CASE} AS decision, {WHY} AS explanation FROM labels")(decided)


@register("rule_decision_counts", f"SELECT {CASE} AS decision, count(*) AS n FROM labels GROUP BY 1")
def rule_decision_counts(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("decision").agg(F.count("*").alias("n"))


@register("rule_decision_by_lang", f"SELECT lang, {CASE} AS decision, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def rule_decision_by_lang(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return decided(spark, sf_dir).join(langs, "doc_id").groupBy("lang", "decision").agg(F.count("*").alias("n"))


@register("rules_data_driven", f"SELECT dsl, doc_id, {CASE} AS outcome FROM labels, (VALUES ('de_jure'), ('odrl'), ('legalruleml')) v(dsl)")
def rules_data_driven(spark, sf_dir):
    """Labels decided by three rule files, each read in its own format."""
    return rules.apply_rules(facts(spark, sf_dir), rules.shipped_rules(spark)).select("dsl", "doc_id", "outcome")


@register("rules_equivalence", f"SELECT dsl, quality::INT AS \"X\", toxic::INT AS \"Z\", count(*) AS n, count(DISTINCT {CASE}) AS outcomes, true AS agrees FROM labels, (VALUES ('de_jure'), ('odrl'), ('legalruleml')) v(dsl) GROUP BY 1, 2, 3")
def rules_equivalence(spark, sf_dir):
    """For each rule file and state of facts: does it always give what the rule in code gives?"""
    own = rules.decision(F.col("X") == 1, F.col("Z") == 1)["decision"]
    ruled = rules.apply_rules(facts(spark, sf_dir), rules.shipped_rules(spark))
    return ruled.groupBy("dsl", "X", "Z").agg(F.count("*").alias("n"), F.count_distinct("outcome").alias("outcomes"), F.bool_and(F.col("outcome") == own).alias("agrees"))


#: Rules over orders: (id, outcome, conditions, exceptions, defeaters).
ORDER_RULES = (
    ("large", "review", [("price", "gteq", "200000")], [[("status", "eq", "F"), ("priority", "neq", "1-URGENT")]], []),
    ("small", "pass", [("price", "lt", "50000.5"), ("status", "neq", "P")], [], ["large", "hurry"]),
    ("middle", "pass", [("price", "gteq", "50000.5"), ("price", "lteq", "150000")], [], []),
    ("hurry", "first", [("priority", "eq", "1-URGENT"), ("status", "eq", "O")], [], ["middle"]),
    ("any", "log", [], [[("price", "gt", "100000")]], []),
)
RULE_SCHEMA = f"dsl string, rule_id string, outcome string, conditions {files.CONDITIONS}, exceptions array<{files.CONDITIONS}>, defeaters array<string>"
PRICE, STATE, RANK = "o_totalprice", "o_orderstatus", "o_orderpriority"
HURRY = f"({RANK} = '1-URGENT' AND {STATE} = 'O' AND NOT ({PRICE} >= 50000.5 AND {PRICE} <= 150000))"


@register(
    "rules_indexed",
    f"""SELECT o_orderkey, unnest(list_filter([CASE WHEN {PRICE} >= 200000 AND NOT ({STATE} = 'F' AND {RANK} <> '1-URGENT') THEN 'large:review' END, CASE WHEN {PRICE} < 50000.5 AND {STATE} <> 'P' AND NOT {HURRY} THEN 'small:pass' END,
      CASE WHEN {PRICE} >= 50000.5 AND {PRICE} <= 150000 THEN 'middle:pass' END, CASE WHEN {HURRY} THEN 'hurry:first' END, CASE WHEN NOT {PRICE} > 100000 THEN 'any:log' END], lambda x: x IS NOT NULL)) AS fired FROM orders""",
)
def rules_indexed(spark, sf_dir):
    """All rules that fire for each order, by equality, order, exceptions and defeaters."""
    held = spark.createDataFrame([("orders", *r) for r in ORDER_RULES], RULE_SCHEMA)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col(PRICE).alias("price"), F.col(STATE).alias("status"), F.col(RANK).alias("priority"))
    fired = rules.apply_rules(orders, held, ("price", "status", "priority"))
    return fired.select("o_orderkey", F.concat("rule_id", F.lit(":"), "outcome").alias("fired"))


LOADED = [("de_jure", "U1", "DENIED", "Z=1"), ("de_jure", "U2", "AWARDED", "Z=0,X=1"), ("de_jure", "U3", "DENIED", "Z=0,X=0"), ("legalruleml", "L1", "DENIED", "Z=1"), ("legalruleml", "L2", "AWARDED", "Z=0,X=1"), ("legalruleml", "L3", "DENIED", "Z=0,X=0"), ("odrl", "P1", "AWARDED", "Z=0,X=1"), ("odrl", "P2", "DENIED", "Z=1"), ("odrl", "P3", "DENIED", "Z=0,X=0")]


@register("rule_files", f"SELECT * FROM (VALUES {', '.join(map(str, LOADED))}) v(dsl, rule_id, outcome, conditions)")
def rule_files(spark, sf_dir):
    shown = F.array_join(F.transform("conditions", lambda c: F.concat(c["field"], F.when(c["operator"] == "eq", "=").otherwise("?"), c["value"].cast("string"))), ",")
    return rules.shipped_rules(spark).select("dsl", "rule_id", "outcome", shown.alias("conditions"))


@register("rule_definitions", "SELECT * FROM (VALUES ('X', 'lost-profit rules', 2::BIGINT), ('Z', 'lost-profit rules', 2)) v(term, citation, definitions)")
def rule_definitions(spark, sf_dir):
    path = scratch.shipped(spark, "veridane.rulesets", "units.json")
    terms, about = files.definitions_from_units(spark, path), files.section_from_units(spark, path)
    n = terms.agg(F.count("*").alias("definitions"))
    return terms.select("term").join(F.broadcast(about.select("citation")), F.lit(True)).join(F.broadcast(n), F.lit(True))


# --- scores ---------------------------------------------------------------

RESPONSES = f"""WITH l AS (SELECT *, doc_id // 2 AS pair_id, 'm' || (doc_id // 2) % 3 AS model FROM labels),
    r AS (SELECT model, pair_id, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS side, {CASE} AS expected,
      CASE WHEN model = 'm2' OR doc_id % 7 = 0 THEN 'DENIED' WHEN model = 'm1' AND quality = 1 THEN 'AWARDED' ELSE {CASE} END AS decision, doc_id % 7 <> 0 AS parse_ok FROM l)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of three made-up models to pairs of labelled documents: m0 applies the rule, m1 overlooks substitutes, m2 denies all."""
    f = facts(spark, sf_dir).withColumn("pair_id", F.expr("doc_id div 2")).withColumn("model", F.concat(F.lit("m"), (F.col("pair_id") % 3).cast("string")))
    right = rules.decision(F.col("X") == 1, F.col("Z") == 1)["decision"]
    said = F.when((F.col("model") == "m2") | (F.col("doc_id") % 7 == 0), "DENIED").when((F.col("model") == "m1") & (F.col("X") == 1), "AWARDED").otherwise(right)
    return f.select("model", "pair_id", F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("side"), right.alias("expected"), said.alias("decision"), (F.col("doc_id") % 7 != 0).alias("parse_ok"))


PASSED = f"{RESPONSES}, p AS (SELECT model, pair_id, count(*) AS sides, bool_and(decision = expected) AS passed FROM r GROUP BY 1, 2)"


@register("pair_score", f"{PASSED} SELECT * FROM p")
def pair_score(spark, sf_dir):
    return score.pair_score(responses(spark, sf_dir))


@register("violation_score", f"{PASSED} SELECT model, count(*) AS pairs, count(*) FILTER (NOT passed) AS failed, round(count(*) FILTER (NOT passed) / count(*), 2) AS score, CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM p GROUP BY 1")
def violation_score(spark, sf_dir):
    return score.violation_score(responses(spark, sf_dir))


@register("shortcut_models", f"{RESPONSES} SELECT model, count(DISTINCT decision) AS labels, count(DISTINCT decision) = 1 AS collapsed FROM r GROUP BY 1")
def shortcut_models(spark, sf_dir):
    return score.collapsed(responses(spark, sf_dir))


@register("accuracy_vs_malformed", f"{RESPONSES} SELECT model, round(avg(CASE WHEN decision = expected THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN parse_ok THEN 0.0 ELSE 1.0 END), 6) AS malformed FROM r GROUP BY 1")
def accuracy_vs_malformed(spark, sf_dir):
    return score.accuracy(responses(spark, sf_dir))


@register(
    "flip_check",
    f"""{RESPONSES} SELECT model, pair_id, a.decision <> b.decision AS flipped FROM r a JOIN r b USING (model, pair_id) WHERE a.side = 'A' AND b.side = 'B' AND a.expected <> b.expected""",
)
def flip_check(spark, sf_dir):
    return score.flips(responses(spark, sf_dir))


#: The six counterfactual pairs: id, ground truth and prompts.
PAIRS = (
    ("IP_Causation_Pair_1", "A: AWARDED; B: DENIED", "Evaluate. Infringing Product: Available. Third-Party Substitute: Not Available.", "Evaluate. Infringing Product: Available. Third-Party Substitute: Available."),
    ("IP_Causation_Pair_2", "A: DENIED; B: DENIED", "Evaluate. Infringing Product: Available. Third-Party Substitute: Available.", "Evaluate. Infringing Product: Not Available. Third-Party Substitute: Available."),
    ("IP_Causation_Pair_3", "A: DENIED; B: AWARDED", "Evaluate. Infringing Product: Available. Third-Party Substitute: Available.", "Evaluate. Infringing Product: Available. Third-Party Substitute: Not Available."),
    ("IP_Causation_Pair_4", "A: DENIED; B: DENIED", "Evaluate. X=1, Z=1.", "Evaluate. X=0, Z=1."),
    ("IP_Causation_Pair_5", "A: DENIED; B: AWARDED", "Evaluate. X=1, Z=1.", "Evaluate. X=1, Z=0."),
    ("IP_Causation_Pair_6", "A: AWARDED; B: DENIED", "Evaluate. X=1, Z=0.", "Evaluate. X=1, Z=1."),
)
PAIR_VALUES = ", ".join(str(p) for p in PAIRS)


def pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PAIRS), "id string, ground_truth string, prompt_A string, prompt_B string")


@register("ground_truth_parse", f"""WITH p AS (SELECT * FROM (VALUES {PAIR_VALUES}) v(id, gt, a, b)) SELECT id, gt AS ground_truth, 'A' AS side, split_part(split_part(gt, '; ', 1), ': ', 2) AS expected, a AS prompt FROM p UNION ALL SELECT id, gt, 'B', split_part(split_part(gt, '; ', 2), ': ', 2), b FROM p""")
def ground_truth_parse(spark, sf_dir):
    return prompt.transcript(pairs(spark))


@register(
    "published_replay",
    """SELECT * FROM (VALUES ('all denied', 6::BIGINT, 4::BIGINT, 0.67::DOUBLE, 'FAIL'), ('all right', 6, 0, 0.0, 'PASS')) v(model, pairs, failed, score, verdict)""",
)
def published_replay(spark, sf_dir):
    """The two published outcomes: one model denies all twelve prompts, one is right on all."""
    side = prompt.transcript(pairs(spark)).select(F.col("id").alias("pair_id"), "side", "expected")
    both = side.withColumns({"model": F.lit("all denied"), "decision": F.lit("DENIED")}).unionByName(side.withColumns({"model": F.lit("all right"), "decision": F.col("expected")}))
    return score.violation_score(both)


# --- extraction -----------------------------------------------------------

I, S = extract.INFRINGING, extract.SUBSTITUTE
F3 = extract.FENCE
#: response, decision, explanation, parse_ok
EDGES = (
    (f'{{"{I}": true, "{S}": false}}', "AWARDED", rules.GRANTED, True),
    (f'{{"{I}": true, "{S}": true}}', "DENIED", rules.SUBSTITUTE, True),
    (f'{{"{I}": false, "{S}": false}}', "DENIED", rules.ABSENT, True),
    (f'{{"{I.upper()}": true, "{S.upper()}": false}}', "AWARDED", rules.GRANTED, True),
    (f'{{"{I}": true, "{S}": "false"}}', "DENIED", rules.SUBSTITUTE, True),
    (f'{{"{I}": 1, "{S}": 0}}', "AWARDED", rules.GRANTED, True),
    (f'{{"{I}": [0], "{S}": null}}', "AWARDED", rules.GRANTED, True),
    (f'{{"{I}": {{}}, "{S}": ""}}', "DENIED", rules.ABSENT, True),
    (f'{{"x": 1}} {{"{I}": true, "{S}": false}}', "AWARDED", rules.GRANTED, True),
    (f'{{"r": {{"{I}": true, "{S}": false}}}}', "DENIED", extract.PARSE_FAILED, False),
    (f'{F3}json\n{{"{I}": true, "{S}": false}}\n{F3}', "AWARDED", rules.GRANTED, True),
    (f'{F3}json {{"{I}": true, "{S}": false}}', "DENIED", extract.PARSE_FAILED, False),
    (f'A 6" bolt: {{"{I}": true, "{S}": false}}', "DENIED", extract.PARSE_FAILED, False),
    (f'{{"{I}": true, "{S}": false', "DENIED", extract.PARSE_FAILED, False),
    (f'}} {{"{I}": true, "{S}": false}}', "AWARDED", rules.GRANTED, True),
    (f'{{"note": "a }} b", "{I}": true, "{S}": false}}', "AWARDED", rules.GRANTED, True),
    (f"{{'{I}': true, '{S}': false}}", "DENIED", extract.PARSE_FAILED, False),
    (f'{{"{I}": true, "{I}": false, "{S}": false}}', "DENIED", rules.ABSENT, True),
    (f'{{"{I}": NaN, "{S}": 0}}', "AWARDED", rules.GRANTED, True),
    (f'{{"{I}": -Infinity, "note": "NaN", "{S}": false}}', "AWARDED", rules.GRANTED, True),
    (f'{{"{I}": true, "{S}": Infinity}}', "DENIED", rules.SUBSTITUTE, True),
    (f'{{"{I}": true, "deep": {"[" * 900}{"]" * 900}, "{S}": false}}', "AWARDED", rules.GRANTED, True),
    (f'{{"{I}": false, "{I.upper()}": true, "{S}": true, "{S}": false}}', "AWARDED", rules.GRANTED, True),
    (f'\x1c{F3}\x1d{{"{I}": true, "{S}": false}}\x1e{F3}\x1f', "AWARDED", rules.GRANTED, True),
    ('{"error": "generation_failed", "reason": "x"}', "DENIED", extract.PARSE_FAILED, False),
    ("", "DENIED", extract.PARSE_FAILED, False),
    (f'JSON {{"{I}": 0.0, "{S}": []}}', "DENIED", rules.ABSENT, True),
    (f'{{"{I}": true, "note": "\\"}}", "{S}": false}}', "AWARDED", rules.GRANTED, True),
    (f'{{"{I}": true, "n": +Infinity, "{S}": false}}', "DENIED", extract.PARSE_FAILED, False),
    (f'{{"{I}": true, "n": -INF, "{S}": false}}', "DENIED", extract.PARSE_FAILED, False),
    (f'{{"{I}": true, "n": 1{"0" * 1500}, "{S}": false}}', "AWARDED", rules.GRANTED, True),
    (f'{{"{I}": true, "{"k" * 60000}": 1, "{S}": false}}', "AWARDED", rules.GRANTED, True),
    (f'{{"{I}": true, "in": {{"a": 1, "a": 2}}, "{S}": false}}', "AWARDED", rules.GRANTED, True),
    (f'{{"{I}": true, "deep": {"[" * 3000}{"]" * 3000}, "{S}": false}}', "AWARDED", rules.GRANTED, True),
    (f'{{"{I}": true, "n": 01, "{S}": false}}', "DENIED", extract.PARSE_FAILED, False),
    (f'{{"{I}": true, "n": 1., "{S}": false}}', "DENIED", extract.PARSE_FAILED, False),
    (f'{{"{I}": true, "{S}": false,}}', "DENIED", extract.PARSE_FAILED, False),
    (f'{{"{I}": true, "n": [1,], "{S}": false}}', "DENIED", extract.PARSE_FAILED, False),
    (f'{{"{I}": true, "n": [}}], "{S}": false}}', "DENIED", extract.PARSE_FAILED, False),
    (f'{{"{I}": true "{S}": false}}', "DENIED", extract.PARSE_FAILED, False),
    (f'{{"{I}": True, "{S}": false}}', "DENIED", extract.PARSE_FAILED, False),
    (f'{{"{I}": true, "n": "a\tb", "{S}": false}}', "DENIED", extract.PARSE_FAILED, False),
    (f'{{"{I}": true, "n": "\\x", "{S}": false}}', "DENIED", extract.PARSE_FAILED, False),
    (f'{{"\\u0069{I[1:]}": true, "{S}": false}}', "AWARDED", rules.GRANTED, True),
    (f'{{"{I}": 1e-999, "{S}": -0}}', "DENIED", rules.ABSENT, True),
    (f'{{"{I}": -0.5E+2, "{S}": 0e9}}', "AWARDED", rules.GRANTED, True),
    (f'{{"{I}": true, "n": 01, "{S}": true}} {{"{I}": true, "{S}": false}}', "AWARDED", rules.GRANTED, True),
)


@register("predicate_extract", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{d}', '{w}', {str(ok).lower()})" for k, (_, d, w, ok) in enumerate(EDGES)) + ") v(k, decision, explanation, parse_ok)")
def predicate_extract(spark, sf_dir):
    rows = spark.createDataFrame([(k, r) for k, (r, *_) in enumerate(EDGES)], "k int, raw string")
    return extract.decide(rows).drop("raw")


@register("predicate_extract_labels", f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'DENIED' ELSE {CASE} END AS decision, CASE WHEN doc_id % 5 = 0 THEN '{extract.PARSE_FAILED}' ELSE {WHY} END AS explanation, doc_id % 5 <> 0 AS parse_ok FROM labels")
def predicate_extract_labels(spark, sf_dir):
    """Responses made from labels, in prose, with a decoy object; every fifth one is cut off."""
    whole = F.format_string('Answer: {"n": %d} {"' + I + '": %d, "' + S + '": %d}', "doc_id", "X", "Z")
    raw = F.when(F.col("doc_id") % 5 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    return extract.decide(facts(spark, sf_dir).select("doc_id", raw.alias("raw"))).drop("raw")


STRICT = "CASE event_id % 10 WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN false WHEN 8 THEN false WHEN 9 THEN false ELSE true END"


@register("strict_decode", f"SELECT event_id, {STRICT} AS parse_ok, CASE WHEN {STRICT} AND (event_id // 10) % 3 > 0 THEN 'AWARDED' ELSE 'DENIED' END AS decision FROM events")
def strict_decode(spark, sf_dir):
    """Responses made from events' own JSON objects: well-formed ones, some of them odd, and ones that only look so."""
    k, n = F.col("event_id") % 10, F.expr("event_id div 10")
    # Odd but well-formed: a key twice inside, deep nesting, escapes in a key, a long number, a key twice of which the last counts.
    more = (
        F.when(k == 0, F.concat(F.lit('"in": {"a": '), "props", F.lit(', "a": 2}')))
        .when(k == 1, '"n": +Infinity').when(k == 2, F.concat(F.lit('"n": 0'), n.cast("string"))).when(k == 3, F.concat(F.lit('"n": ['), "props", F.lit(",]")))
        .when(k == 4, F.concat(F.lit('"n": '), F.expr("repeat('[', cast(event_id % 40 as int))"), "props", F.expr("repeat(']', cast(event_id % 40 as int))")))
        .when(k == 5, F.concat(F.lit('"n": 1'), F.expr("repeat('0', 2000)"))).when(k == 6, '"\\u0069' + I[1:] + '": true, "e": "\\u00e9\\/"').when(k == 7, '"' + I + '": 1e-999, "n": [NaN, -Infinity]')
        .when(k == 8, F.concat(F.lit('"n": "\t'), n.cast("string"), F.lit('"'))).otherwise(F.concat(F.lit('"n": {"a" '), n.cast("string"), F.lit("}")))
    )
    said = F.concat(F.lit("{"), more, F.lit(', "' + I + '": '), (n % 3).cast("string"), F.lit(', "' + S.upper() + '": ""}'))
    return extract.decide(table(spark, sf_dir, "events").select("event_id", said.alias("raw"))).select("event_id", "parse_ok", "decision")


@register("json_objects", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END::BIGINT AS n, CASE event_id % 4 WHEN 2 THEN NULL WHEN 3 THEN '{\"in\": ' || props || '}' ELSE props END AS first_object FROM events")
def json_objects(spark, sf_dir):
    """Objects in prose: one, two, none behind a quote that never ends, and a nested one beside stray braces."""
    p, k = F.col("props"), F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit("so "), p)).when(k == 1, F.concat(p, F.lit(' "{" and '), p)).when(k == 2, F.concat(F.lit('6" of '), F.replace(p, F.lit('"'), F.lit("'")))).otherwise(F.concat(F.lit('}} {"in": '), p, F.lit("} {")))
    found = extract.json_objects(text)
    rows = table(spark, sf_dir, "events").select("event_id", found.alias("o"))
    return rows.select("event_id", F.size("o").cast("long").alias("n"), F.get("o", F.lit(0)).alias("first_object"))


@register("grammar_conformance", "SELECT doc_id, doc_id % 4 = 0 OR (doc_id % 4 = 2 AND toxic = 0) AS conforms FROM labels")
def grammar_conformance(spark, sf_dir):
    """Responses made from labels, tested by the shipped grammar file: well-formed, with something behind, with booleans of which one is in capitals, and with something before."""
    b = lambda c: F.when(F.col(c) == 1, "true").otherwise("false")
    made = lambda z: F.concat(F.lit('{ "' + I + '" :\n'), b("X"), F.lit(', "' + S + '":\t'), z, F.lit("}"))
    good, loud = made(b("Z")), made(F.when(F.col("Z") == 1, "TRUE").otherwise("false"))
    raw = F.when(F.col("doc_id") % 4 == 0, good).when(F.col("doc_id") % 4 == 1, F.concat(good, F.lit(" {}"))).when(F.col("doc_id") % 4 == 2, loud).otherwise(F.concat(F.lit("x"), good))
    expression = extract.constraint(spark, scratch.shipped(spark, "veridane.rulesets", "predicates.gbnf"))
    return facts(spark, sf_dir).select("doc_id", grammar.conforms(raw, expression).alias("conforms"))


#: A grammar for events' own objects: a key, and a number that is no multiple of ten.
COUNTER = r'''
root ::= "{" blank* "\"k\":" blank* number blank* "}"   # as events write it
number ::= "-"? ( [1-9] | [1-9] digit{0,17} [1-9] )
digit ::= [0-9]
blank ::= [\x20\t]
'''


@register("grammar_other", """SELECT event_id, coalesce(regexp_full_match(props, '\\{[ \\t]*"k":[ \\t]*-?[1-9]([0-9]*[1-9])?[ \\t]*\\}'), false) AS conforms FROM events""")
def grammar_other(spark, sf_dir):
    """Events' objects by another grammar, through a file."""
    path = scratch.fresh(spark, "counter.gbnf")
    spark.createDataFrame([(COUNTER,)], "value string").coalesce(1).write.text(path)
    return table(spark, sf_dir, "events").select("event_id", grammar.conforms(F.col("props"), extract.constraint(spark, path)).alias("conforms"))


# --- transcripts ------------------------------------------------------------

PROMPT = "'Evaluate. X=' || quality || ', Z=' || toxic || '.'"
OUTPUT = f"""CASE WHEN doc_id % 5 = 0 THEN 'I cannot say.' ELSE '{{"{I}": ' || CASE WHEN quality = 1 THEN 'true' ELSE 'false' END || ', "{S}": ' || CASE WHEN toxic = 1 AND doc_id % 3 > 0 THEN 'true' ELSE 'false' END || '}}' END"""
SAID = "CASE WHEN doc_id % 5 = 0 THEN 'DENIED' WHEN toxic = 1 AND doc_id % 3 > 0 THEN 'DENIED' WHEN quality = 1 THEN 'AWARDED' ELSE 'DENIED' END"
REASON = f"CASE WHEN doc_id % 5 = 0 THEN '{extract.PARSE_FAILED}' WHEN toxic = 1 AND doc_id % 3 > 0 THEN '{rules.SUBSTITUTE}' WHEN quality = 1 THEN '{rules.GRANTED}' ELSE '{rules.ABSENT}' END"


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, prompt, raw, expected) with decision, explanation and parse_ok: a made-up model that overlooks every third substitute and fails on every fifth prompt."""
    f = facts(spark, sf_dir)
    b = lambda c: F.when(c, "true").otherwise("false")
    json = F.concat(F.lit('{"' + I + '": '), b(F.col("X") == 1), F.lit(', "' + S + '": '), b((F.col("Z") == 1) & (F.col("doc_id") % 3 > 0)), F.lit("}"))
    raw = F.when(F.col("doc_id") % 5 == 0, "I cannot say.").otherwise(json)
    asked = F.concat(F.lit("Evaluate. X="), F.col("X").cast("string"), F.lit(", Z="), F.col("Z").cast("string"), F.lit("."))
    right = rules.decision(F.col("X") == 1, F.col("Z") == 1)["decision"]
    return extract.decide(f.select("doc_id", asked.alias("prompt"), raw.alias("raw"), right.alias("expected")))


@register("transcript", f"SELECT doc_id, {PROMPT} AS prompt, {CASE} AS expected, {OUTPUT} AS raw, {SAID} AS decision, {REASON} AS explanation FROM labels")
def transcript(spark, sf_dir):
    """What a run prints for each prompt: prompt, ground truth, final decision with its explanation, and the raw response."""
    return answered(spark, sf_dir).select("doc_id", "prompt", "expected", "raw", "decision", "explanation")


@register("response_rows", f"SELECT 'made-up' AS model_id, 'labels_' || doc_id AS prompt_id, {PROMPT} AS prompt_text, {CASE} AS expected_label, {OUTPUT} AS model_output, {SAID} AS parsed_decision, {SAID} = {CASE} AS correct, doc_id % 5 <> 0 AS parse_ok FROM labels")
def response_rows(spark, sf_dir):
    """Result rows as the evaluation report proposes them."""
    a = answered(spark, sf_dir)
    return a.select(F.lit("made-up").alias("model_id"), F.concat(F.lit("labels_"), F.col("doc_id").cast("string")).alias("prompt_id"), F.col("prompt").alias("prompt_text"), F.col("expected").alias("expected_label"), F.col("raw").alias("model_output"), F.col("decision").alias("parsed_decision"), (F.col("decision") == F.col("expected")).alias("correct"), "parse_ok")


@register(
    "failed_prompts",
    f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '{{"error":"prompt_failed","reason":"time out after ' || doc_id || ' s"}}' ELSE {OUTPUT} END AS raw, CASE WHEN doc_id % 4 = 0 THEN 'DENIED' ELSE {SAID} END AS decision,
      CASE WHEN doc_id % 4 = 0 THEN '{extract.EXECUTION_FAILED}time out after ' || doc_id || ' s' ELSE {REASON} END AS explanation, doc_id % 4 <> 0 AND doc_id % 5 <> 0 AS parse_ok FROM labels""",
)
def failed_prompts(spark, sf_dir):
    """Every fourth prompt can't be run; its failure decides, though a response lies there."""
    said = answered(spark, sf_dir).drop("decision", "explanation", "parse_ok")
    why = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("time out after "), F.col("doc_id").cast("string"), F.lit(" s")))
    return extract.decide(said.withColumn("why", why), failure="why").select("doc_id", "raw", "decision", "explanation", "parse_ok")
