"""Grammars compiled from files."""

import pytest
from pyspark.sql import functions as F

from veridane.operators import extract, grammar
from veridane.sources import scratch


def sentences(spark, text, candidates, root="root"):
    df = spark.createDataFrame([(k, c) for k, c in enumerate(candidates)], "k int, c string")
    return [r["ok"] for r in df.select("k", grammar.conforms(F.col("c"), grammar.compiled(text, root)).alias("ok")).orderBy("k").collect()]


def test_rules_in_any_order_and_all_forms(spark):
    text = r"""
    pair ::= key ":" ( num | "nil" ) tail?   # comment with "quotes"
    root ::= "<" pair ("," pair)* ">" | "[]\n"
    tail ::= [^a-z\]\-] .
    key ::= [a-c_]{2,3}
    num ::= "-"? [0-9]+ ("." [0-9]{2})?
    """
    good = ["<ab:1>", "<abc:-12.34,__:nil>", "[]\n", "<ab:1!x>", "<ab:nil \n>", "<ab:1.2>"]
    bad = ["", "<>", "<a:1>", "<abca:1>", "<ab:1,>", "[]", "<ab:1>\n", " <ab:1>", "<ab:1ax>", "<ab:nil-x>", None]
    assert sentences(spark, text, good + bad) == [True] * len(good) + [False] * len(bad)


def test_the_shipped_grammar_and_what_stands_in_for_it(spark, tmp_path):
    path = scratch.shipped(spark, "veridane.rulesets", "predicates.gbnf")
    held, free = extract.constraint(spark, path), extract.constraint(spark, str(tmp_path / "missing.gbnf"))
    assert free == extract.FORMAT != held
    made = lambda gap: f'{{{gap}"{extract.INFRINGING}":{gap}true,{gap}"{extract.SUBSTITUTE}" : false}}'
    rows = [made(""), made("\n\t "), made("\x0b"), made("") + " ", made("").replace("true", "1")]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, r string")
    got = [tuple(r)[1:] for r in df.select("k", grammar.conforms(F.col("r"), held), grammar.conforms(F.col("r"), free)).orderBy("k").collect()]
    assert got == [(True, True), (True, True), (False, True), (False, False), (False, False)]


@pytest.mark.parametrize(
    ("text", "why"),
    [("root ::= a\na ::= b\nb ::= a", "itself"), ("root ::= root", "itself"), ("root ::= a", "not defined"), ("x ::= [a]", "not defined"), ("root ::= (\"a\"", "brackets"), ("root ::= \"a\")", "brackets"), ("root ::= *", "nothing"), ("root ::= [a]**", "nothing"), ("root ::=", "empty"), ("root ::= ?", "nothing"), ("\"a\"", "no rule"), ("root ::= ~", "read"), ("root ::= \"a\nroot ::= b", "read"), ("root ::= \"a\"\nroot ::= \"b\"", "twice"), ("", "not defined")],
)
def test_errors(text, why):
    with pytest.raises(grammar.GrammarError, match=why):
        grammar.compiled(text)


def test_a_broken_file_is_no_missing_file(spark, tmp_path):
    (tmp_path / "g.gbnf").write_text("root ::= root")
    with pytest.raises(grammar.GrammarError, match="itself"):
        extract.constraint(spark, str(tmp_path / "g.gbnf"))
