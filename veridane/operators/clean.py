"""Cleaning of question records: segmentation of statements and routing. All row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridane.functions.text import bound, statement_text, trim_ws

#: Label schemes.
CIRCLED = ("①", "②", "③", "④", "⑤")
LETTERS = ("(a)", "(b)", "(c)", "(d)", "(e)")

#: Records by treatment.
MANUAL_IDS = ("2025_05",)
AUTO_IDS = ("2021_25", "2021_34", "2022_19", "2023_11", "2023_17", "2023_29", "2024_27", "2025_17", "2025_39")
COSMETIC_IDS = ("2021_13", "2022_08", "2023_29", "2024_06", "2024_22", "2024_29", "2025_23")
FALSE_POSITIVE_IDS = ("2022_36", "2023_19", "2024_25", "2025_21", "2025_01")
INCONSISTENT_IDS = ("2021_01", "2021_13", "2021_15", "2023_37")

#: Statements of the manual record.
MANUAL_PATCH = {
    "statement_1": "(a). If Alice, an adult, hands over a manual containing all information about her property to Bob, a minor who has graduated from college, and then enters into a sales contract with him, the control of this contract is not justified by A, but is justified by B.",
    "statement_2": "(b). If Charlie, a minor, sells his bicycle at a price much lower than the market price to David, an adult whom he has never met before through an online brokerage platform, the control of this contract is justified by A but not justified by B.",
    "statement_3": "(c). If adult Eve and State X both know all information regarding a certain piece of land and then enter into a sales contract regarding that land, the control of this contract is justified neither by A nor by B.",
}

#: Fixed value: statements of the uncleaned set.
EXPECTED_TOTAL = 315


#: A value that an expression names more than once, made once, also inside nested lambdas.
let = bound


def find(text: Column, what: str, after: Column | None = None) -> Column:
    """1-based place of `what` in text at or behind `after`; 0 if there is none."""
    return F.instr(text, what) if after is None else F.position(F.lit(what), text, after)


def span_between(text: Column, start: str, end: str) -> Column:
    """What stands between the first `start` and the first `end` behind it, trimmed; null if a mark is missing or nothing is left."""
    begin = let(find(text, start), lambda a: F.when(a > 0, a + len(start)))
    ends = let(begin, lambda a: F.named_struct(F.lit("a"), a, F.lit("b"), find(text, end, a)))
    return let(ends, lambda p: F.when(p["b"] > 0, F.nullif(trim_ws(F.substring(text, p["a"], p["b"] - p["a"])), F.lit(""))))


def label_scheme(span: Column) -> Column:
    """'circled', 'letters' or null, by the scheme of the first label of either in the text."""
    first = F.regexp_extract(span, r"[①②③④⑤]|\([a-e]\)", 0)
    return let(first, lambda m: F.when(F.startswith(m, F.lit("(")), "letters").when(m != "", "circled"))


def split_labels(span: Column, labels: tuple[str, ...]) -> Column:
    """Entries (key, value) of the pieces that begin at each expected label in turn; stops at the first that is missing; null if none is there."""

    def step(state: Column, label: Column) -> Column:
        at = F.when(state["behind"] > 0, F.position(label, span, state["behind"])).otherwise(0)
        return let(at, lambda p: F.named_struct(F.lit("at"), F.concat(state["at"], F.array(p)), F.lit("behind"), F.when(p > 0, p + F.length(label)).otherwise(0)))

    start = F.named_struct(F.lit("at"), F.array().cast("array<int>"), F.lit("behind"), F.lit(1))
    places = F.aggregate(F.array(*[F.lit(x) for x in labels]), start, step, lambda state: F.filter(state["at"], lambda p: p > 0))

    def cut(at: Column) -> Column:
        def piece(p: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(at, k + 1), F.length(span) + 1)
            return F.named_struct(F.lit("key"), F.concat(F.lit("statement_"), (k + 1).cast("string")), F.lit("value"), statement_text(F.substring(span, p, stop - p)))

        return F.when(F.size(at) > 0, F.transform(at, piece))

    return let(places, cut)


def source_span(question: Column) -> Column:
    """The part of a question that holds its statements.

    Between <statements> and <choices>; else all behind <choices>, also if that is
    empty; else, before <question>, from the first "(a)" or "①".
    """
    choices, ask = find(question, "<choices>"), find(question, "<question>")
    behind = trim_ws(F.substring(question, choices + len("<choices>"), F.length(question)))
    head = F.substring(question, F.lit(1), ask - 1)
    starts = F.array_min(F.filter(F.array(find(head, "(a)"), find(head, "①")), lambda p: p > 0))
    third = F.when(starts.isNotNull(), trim_ws(F.substring(head, starts, F.length(head))))
    return F.coalesce(span_between(question, "<statements>", "<choices>"), F.when(choices > 0, behind), F.when(ask > 0, third))


def resegment(question: Column) -> Column:
    """Statements as entries (key, value) from a question's text; null if it has no labelled statements."""

    def split(span: Column) -> Column:
        return let(label_scheme(span), lambda s: F.when(s == "circled", split_labels(span, CIRCLED)).when(s == "letters", split_labels(span, LETTERS)))

    return let(source_span(F.coalesce(question, F.lit(""))), split)


def normalise_entries(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.named_struct(F.lit("key"), e["key"], F.lit("value"), statement_text(e["value"])))


def n_statements(entries: Column) -> Column:
    """Null counts as 0."""
    return F.coalesce(F.size(entries), F.lit(0)).cast("long")


def route(key: Column) -> Column:
    """Treatment of a record: manual before auto before cosmetic; else null."""
    return F.when(key.isin(*MANUAL_IDS), "manual").when(key.isin(*AUTO_IDS), "auto").when(key.isin(*COSMETIC_IDS), "cosmetic")


def manual_patch() -> Column:
    """The shipped patch as entries, for the records that it is for."""
    entries = F.array(*[F.named_struct(F.lit("key"), F.lit(k), F.lit("value"), F.lit(v)) for k, v in MANUAL_PATCH.items()])
    return F.when(F.col("id").isin(*MANUAL_IDS), entries)


def clean(questions: DataFrame, patches: Column | None = None) -> DataFrame:
    """questions (id, original_question, statements as entries) with mode, new_statements, logged and warning.

    patches: statements, as entries, of manual records, by default the shipped ones; one without a patch is left as it is and gets a warning. An auto record that can't be segmented keeps its
    statements and gets a warning; a cosmetic one is logged only if it changes.
    """
    patch = patches if patches is not None else manual_patch()
    q = questions.withColumn("mode", route(F.col("id"))).withColumn("auto", F.when(F.col("mode") == "auto", resegment(F.col("original_question"))))
    q = q.withColumn("cosmetic", F.when(F.col("mode") == "cosmetic", normalise_entries(F.col("statements"))))
    new = F.when(F.col("mode") == "manual", F.coalesce(patch, F.col("statements"))).when(F.col("mode") == "auto", F.coalesce("auto", "statements")).when(F.col("mode") == "cosmetic", F.col("cosmetic")).otherwise(F.col("statements"))
    changed = F.when(F.col("mode") == "manual", patch.isNotNull()).when(F.col("mode") == "auto", F.col("auto").isNotNull()).when(F.col("mode") == "cosmetic", ~F.col("cosmetic").eqNullSafe(F.col("statements"))).otherwise(False)
    warning = F.when((F.col("mode") == "auto") & F.col("auto").isNull(), "no statements found").when((F.col("mode") == "manual") & patch.isNull(), "no patch")
    return q.select("*", new.alias("new_statements"), changed.alias("logged"), warning.alias("warning")).drop("auto", "cosmetic")


def change_log(cleaned: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return cleaned.filter("logged").select("id", *keep, n_statements(F.col("statements")).alias("old_count"), n_statements(F.col("new_statements")).alias("new_count"), "mode")


def totals(cleaned: DataFrame, expected: int = EXPECTED_TOTAL) -> DataFrame:
    sums = cleaned.agg(F.count("*").alias("records"), F.coalesce(F.sum(n_statements(F.col("statements"))), F.lit(0)).alias("before"), F.coalesce(F.sum(n_statements(F.col("new_statements"))), F.lit(0)).alias("after"))
    return sums.withColumn("warning", F.when(F.col("after") != expected, F.concat(F.lit("expected "), F.lit(expected), F.lit(" statements"))))


def drop_inconsistent(questions: DataFrame, ids: tuple[str, ...] = INCONSISTENT_IDS) -> DataFrame:
    return questions.filter(~F.coalesce(F.col("id").isin(*ids), F.lit(False)))


def circled_choices(text: Column) -> Column:
    """"1." to "5." at a line's start as ① to ⑤."""
    out = text
    for k, mark in enumerate(CIRCLED, 1):
        out = F.regexp_replace(out, rf"(?m)^{k}\.", mark)
    return out
