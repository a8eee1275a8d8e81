"""Text normalisation and text predicates, as column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that are instructions, not statements.
INSTRUCTION_PHRASES = ("<statements>", "<choices>", "<question>", "which of the following", "choose all that apply", "select the most appropriate", "which statement", "which of the above")

#: What a finished statement ends with.
FINAL_MARKS = (".", "?", "!", "}", "’", '"', "'", "”", "）", ")")

#: The characters of Unicode's White_Space property, and the four separators that count as white space too.
WHITE_SPACE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: The same as a class of a regular expression.
SPACE = r"[\s\x1c-\x1f]"

MIN_STATEMENT_CHARS = 10


def trim_ws(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def statement_text(c: Column) -> Column:
    """A statement trimmed, its leading "(a) ." written "(a)."; null gives an empty string."""
    return F.regexp_replace(trim_ws(F.coalesce(c, F.lit(""))), rf"(?U)^\(([a-z])\){SPACE}+\.", r"($1).")


def comparable(c: Column) -> Column:
    """For comparison: "(a) ." as "(a)." anywhere, white space runs as one space, trimmed; null gives an empty string."""
    labels = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U)\(([a-z])\){SPACE}+\.", r"($1).")
    return trim_ws(F.regexp_replace(labels, f"(?U){SPACE}+", " "))


def bound(value: Column, use) -> Column:
    """use(value), with value made once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def leaks_instruction(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return bound(low, lambda t: functools.reduce(lambda a, b: a | b, [F.contains(t, F.lit(phrase)) for phrase in INSTRUCTION_PHRASES]))


def ends_finished(c: Column) -> Column:
    last = F.right(trim_ws(F.coalesce(c, F.lit(""))), F.lit(1))
    return last.isin(*FINAL_MARKS)


def too_short(c: Column) -> Column:
    return F.length(trim_ws(F.coalesce(c, F.lit("")))) < MIN_STATEMENT_CHARS
