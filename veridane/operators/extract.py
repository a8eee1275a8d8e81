"""Extraction of two predicates from a model's free-form response, failing closed.

The scanner for top-level JSON objects folds over a response's strings, braces
and what lies between, in chunks, so it is about linear in the response; all
stays in the JVM, and nothing depends on session settings. Objects are decoded
strictly and without limits of depth, digits or length of keys (`strict_json`); what
is no JSON fails closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridane.functions.folds import folded
from veridane.functions.strict_json import object_entries
from veridane.functions.text import trim_ws
from veridane.operators import grammar, rules
from veridane.operators.clean import let

#: Names and message of the response format.
INFRINGING, SUBSTITUTE = "infringing_product_available", "substitute_product_available"
PARSE_FAILED = "Parsing failed: Response JSON does not contain the required predicate fields"
EXECUTION_FAILED = "Prompt execution failed: "
FENCE = "```"
#: What ends a line.
LINE_END = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x85\u2028\u2029]"
#: A string, closed or not; a brace; all else.
TOKEN = r'(?s)"(?:[^"\\]++|\\.)*+(?:"|\\?\z)|[{}]|[^"{}]++'


def strip_fences(raw: Column) -> Column:
    """Without code-fence lines, if the text begins with one, and without a leading "json"."""
    t = trim_ws(F.coalesce(raw, F.lit("")))
    lines = F.filter(F.split(t, LINE_END), lambda x: ~F.startswith(x, F.lit(FENCE)))
    bare = F.when(F.startswith(t, F.lit(FENCE)), trim_ws(F.array_join(lines, "\n"))).otherwise(t)
    return let(bare, lambda b: F.when(F.lower(F.left(b, F.lit(4))) == "json", trim_ws(F.substring(b, F.lit(5), F.length(b)))).otherwise(b))


def object_spans(tokens: Column) -> Column:
    """Array of (at, n): the tokens of each top-level balanced {...}; a closing brace outside of any counts for nothing."""

    def step(s, token: Column):
        open_, close = token == "{", (token == "}") & (s["depth"] > 0)
        span = F.when(close & (s["depth"] == 1), F.struct(s["at"].alias("at"), (s["i"] - s["at"] + 1).alias("n")))
        at = F.when(open_ & (s["depth"] == 0), s["i"]).otherwise(s["at"])
        return {"i": s["i"] + 1, "depth": s["depth"] + open_.cast("int") - close.cast("int"), "at": at}, span

    return folded(tokens, {"i": F.lit(1), "depth": F.lit(0), "at": F.lit(0)}, step, "struct<at:int,n:int>", lambda _, spans: spans)


def json_objects(text: Column) -> Column:
    """Texts of the top-level objects; quotes count everywhere, also outside objects; a text without a brace isn't scanned."""
    whole = let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.transform(object_spans(t), lambda s: F.array_join(F.slice(t, s["at"], s["n"]), "")))
    return F.when(F.contains(text, F.lit("{")), whole).otherwise(F.array().cast("array<string>"))


def last_truth(entries: Column, name: str) -> Column:
    """Truth of the value of a key in any case: of its spellings the one that first appears last decides, and of that its last value."""
    own = F.filter(entries, lambda e: F.lower(e["key"]) == name)
    spelling = F.element_at(F.array_distinct(F.transform(own, lambda e: e["key"])), -1)
    return F.when(F.size(own) > 0, let(spelling, lambda k: F.element_at(F.filter(own, lambda e: e["key"] == k), -1)["truth"]))


def predicates(raw: Column) -> Column:
    """STRUCT(x, z) from the first top-level object with both keys, or null."""

    def decoded(candidate: Column) -> Column:
        # An object without both names, in any case, has not both keys, unless a name is written with escapes.
        named = let(F.lower(candidate), lambda c: F.contains(c, F.lit(INFRINGING)) & F.contains(c, F.lit(SUBSTITUTE)) | F.contains(c, F.lit("\\u")))
        has = lambda e, name: F.exists(e, lambda x: F.lower(x["key"]) == name)
        both = lambda e: has(e, INFRINGING) & has(e, SUBSTITUTE)
        found = let(object_entries(candidate), lambda e: F.when(both(e), F.struct(last_truth(e, INFRINGING).alias("x"), last_truth(e, SUBSTITUTE).alias("z"))))
        return F.when(named, found)

    objects = json_objects(strip_fences(raw))
    return F.get(F.filter(F.transform(objects, decoded), lambda p: p.isNotNull()), F.lit(0))


def decide(responses: DataFrame, raw: str = "raw", failure: str | None = None) -> DataFrame:
    """responses with decision, explanation and parse_ok; a response without predicates is DENIED.

    failure: a column with the reason why a prompt could not be run, null where it was; it
    decides before the response is looked at, and `raw` becomes the report of it.
    """
    failed = F.lit(False) if failure is None else F.col(failure).isNotNull()
    parsed = responses.withColumn("_p", F.when(~failed, predicates(F.col(raw))))
    denied = lambda why: F.struct(F.lit(rules.DENIED).alias("decision"), why.alias("explanation"))
    made = F.when(F.col("_p").isNotNull(), rules.decision(F.col("_p.x"), F.col("_p.z")))
    if failure is not None:
        made = F.when(failed, denied(F.concat(F.lit(EXECUTION_FAILED), F.col(failure).cast("string")))).otherwise(F.coalesce(made, denied(F.lit(PARSE_FAILED))))
        report = F.to_json(F.struct(F.lit("prompt_failed").alias("error"), F.col(failure).cast("string").alias("reason")))
        parsed = parsed.withColumn(raw, F.when(failed, report).otherwise(F.col(raw)))
    else:
        made = F.coalesce(made, denied(F.lit(PARSE_FAILED)))
    decided = parsed.withColumn("_d", made)
    return decided.select(*responses.columns, F.col("_d.decision").alias("decision"), F.col("_d.explanation").alias("explanation"), F.col("_p").isNotNull().alias("parse_ok"))


#: The output format where no grammar file is there; it takes any white space.
FORMAT = rf'^\{{\s*"{INFRINGING}"\s*:\s*(true|false)\s*,\s*"{SUBSTITUTE}"\s*:\s*(true|false)\s*\}}\z'


def constraint(spark: SparkSession, path: str) -> str:
    """The expression that holds responses to their format: of a grammar file, or FORMAT if it is missing."""
    return grammar.read_grammar(spark, path, FORMAT)
