"""Golden cases of normalisation, segmentation and validation."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridane.functions import text as T
from veridane.operators import clean, validate

ENTRIES = "array<struct<key:string,value:string>>"


def one(spark, column, *values):
    names = [f"c{k}" for k in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(("given_", "want"), [("(a) . If", "(a). If"), ("x (a) . If", "x (a) . If"), ("(A) . If", "(A) . If"), (None, ""), ("  (b)\t. y ", "(b). y"), (" x　", "x")])
def test_statement_text(spark, given_, want):
    assert one(spark, T.statement_text, given_) == want


@pytest.mark.parametrize(
    ("question", "pieces"),
    [
        ("<statements> (a) p (b) q <choices> ① r", ["(a) p", "(b) q"]),
        ("q <choices> ① p ② q", ["① p", "② q"]),
        ("(a) p (b) q <question> w", ["(a) p", "(b) q"]),
        ("<statements><choices> ① p", ["① p"]),
        ("(a) p <question> w <choices> ", None),
        ("<statements> pre (a) one (b) two (d) x <choices>", ["(a) one", "(b) two (d) x"]),
        ("<statements> (b) one (c) two <choices>", None),
        ("<statements> ① a (a) b ② c <choices>", ["① a (a) b", "② c"]),
        ("<statements> (a) x (2) y (B) z (b) w <choices>", ["(a) x (2) y (B) z", "(b) w"]),
        ("nothing here", None),
        (None, None),
    ],
)
def test_resegment(spark, question, pieces):
    got = one(spark, clean.resegment, question)
    assert (got and [e["value"] for e in got]) == pieces
    assert not got or [e["key"] for e in got] == [f"statement_{k + 1}" for k in range(len(got))]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("xyz .", min_size=1, max_size=6), min_size=1, max_size=5))
def test_split_and_join_are_inverse(spark, parts):
    pieces = [f"{label} {p}".strip() for label, p in zip(clean.LETTERS, parts, strict=False)]
    got = one(spark, lambda c: clean.split_labels(c, clean.LETTERS), " ".join(pieces))
    want = [one(spark, T.statement_text, p) for p in pieces]
    assert [e["value"] for e in got] == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("(a) .\n\tx", max_size=20))
def test_comparable_is_idempotent(spark, s):
    once = one(spark, T.comparable, s)
    assert one(spark, T.comparable, once) == once or ") ." in once  # white space that a label's dot leaves behind


def records(spark, *rows):
    return spark.createDataFrame([(i, q, s) for i, q, s in rows], f"id string, original_question string, statements {ENTRIES}")


def test_problems(spark):
    good = "This statement is long enough."
    q = records(
        spark,
        ("n", good, None),
        ("e", good, []),
        ("k", good, [("statement_2", good), ("statement_1", good)]),
        ("s", good, [("statement_1", "123456789")]),
        ("l", good + " Which Of The Following.", [("statement_1", good + " Which Of The Following.")]),
        ("c", "We choose this one (a) .  here.", [("statement_1", "We choose this one (a). here.")]),
        ("2025_05", "other", [("statement_1", good)]),
        ("2021_13", "other", [("statement_1", good)]),
        (None, good, [("statement_1", good)]),
    )
    got = {(r["id"], r["check"]) for r in validate.problems(q).collect()}
    assert got == {("n", "missing"), ("e", "missing"), ("k", "keys"), ("s", "short"), ("s", "punctuation"), ("s", "source"), ("l", "leak"), ("2021_13", "source")}
    gate = validate.gate(q, records=9, total=8).first()
    assert (gate["problems"], gate["unexpected"], gate["verdict"]) == (8, 7, "unexpected problems")
    assert validate.gate(q.filter("id = '2021_13'"), records=1, total=1).first()["verdict"] == "Validation passed."


def test_separators_are_white_space(spark):
    assert one(spark, T.ends_finished, "It ends here.\x1c") and one(spark, T.too_short, "123456789\x1f")
    assert one(spark, T.comparable, "a\x1c\x1db (c)\x1e.") == "a b (c)."
    assert not one(spark, T.ends_finished, "") and not one(spark, T.ends_finished, "open;")


def test_manual_records(spark):
    """The shipped patch goes to its record; without one, a manual record stays, with a warning."""
    q = records(spark, ("2025_05", "", [("statement_1", "x")]), ("zz", "", None))
    r = {x["id"]: x for x in clean.clean(q).collect()}
    assert [e["value"] for e in r["2025_05"]["new_statements"]] == list(clean.MANUAL_PATCH.values()) and r["2025_05"]["logged"] and not r["zz"]["logged"]
    r = {x["id"]: x for x in clean.clean(q, F.lit(None).cast(ENTRIES)).collect()}["2025_05"]
    assert ([e["value"] for e in r["new_statements"]], r["logged"], r["warning"]) == (["x"], False, "no patch")


def test_routing(spark):
    q = records(spark, ("2023_29", "<statements> (a) p (b) q <choices>", [("statement_1", "x")]), ("2021_25", "no labels", [("statement_1", "x")]), ("2022_08", "", [("statement_1", "(a) . x")]), ("2024_06", "", [("statement_1", "(a). x")]), ("zz", "", None))
    got = {r["id"]: (r["mode"], r["logged"], r["warning"]) for r in clean.clean(q).collect()}
    assert got == {"2023_29": ("auto", True, None), "2021_25": ("auto", False, "no statements found"), "2022_08": ("cosmetic", True, None), "2024_06": ("cosmetic", False, None), "zz": (None, False, None)}
    assert {r["id"]: (r["old_count"], r["new_count"]) for r in clean.change_log(clean.clean(q)).collect()} == {"2023_29": (1, 2), "2022_08": (1, 1)}
    t = clean.totals(clean.clean(q)).first()
    assert (t["records"], t["before"], t["after"], t["warning"]) == (5, 4, 5, "expected 315 statements")


def test_nothing(spark):
    q = records(spark, ("x", None, None)).limit(0)
    assert validate.problems(q).count() == 0 and clean.change_log(clean.clean(q)).count() == 0
    assert validate.gate(q).first()["verdict"] == "record count"
    assert clean.totals(clean.clean(q)).first()["after"] == 0
