"""Output grammars: rules of a small grammar file compiled into one anchored expression, for columns to be tested by.

The format: ``name ::= alternatives``, with "literals", [character classes], other
rules' names, groups, the marks * + ? {m,n}, and # comments. Rules may refer to each
other in any order, but not to themselves, as no expression could follow them. A
grammar is a small file; what is distributed is the test of the responses.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veridane.sources import files

#: A piece of a rule; white space and comments between pieces count for nothing.
PIECE = re.compile(r"""\s+|\#[^\n]*|(?P<literal>"(?:[^"\\\n]|\\.)*")|(?P<set>\[(?:[^\]\\]|\\.)+\])|(?P<head>[A-Za-z][\w-]*\s*::=)|(?P<name>[A-Za-z][\w-]*)|(?P<mark>[*+?]|\{\d+(?:,\d*)?\})|(?P<sign>[()|.])""")
ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|(.))", re.DOTALL)
#: Escapes for characters that have none of their own.
NAMED = {"n": "\n", "t": "\t", "r": "\r"}


class GrammarError(ValueError):
    """A grammar that can't be compiled."""


def unescaped(text: str) -> str:
    return ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else NAMED.get(m[3], m[3]), text)


def quoted(text: str) -> str:
    """A literal for Java's expressions."""
    return "".join(c if c.isalnum() or c in " _\"':,;<>=!@%&~`" else f"\\x{{{ord(c):x}}}" for c in text)


def character_class(body: str) -> str:
    """[...] with ranges and a leading ^, for Java's expressions."""
    negated, rest = body.startswith("^"), body.removeprefix("^")
    chars = [(m[0] if len(m[0]) == 1 else unescaped(m[0]), len(m[0]) > 1) for m in re.finditer(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|.)|.", rest, re.DOTALL)]
    out = ""
    for k, (c, escaped) in enumerate(chars):
        between = c == "-" and not escaped and 0 < k < len(chars) - 1
        out += "-" if between else quoted(c)
    return f"[{'^' if negated else ''}{out}]"


def productions(text: str) -> dict[str, list[tuple[str, str]]]:
    """The pieces (kind, text) of each rule, by name."""
    rules: dict[str, list[tuple[str, str]]] = {}
    at, name = 0, None
    while at < len(text):
        m = PIECE.match(text, at)
        if m is None:
            raise GrammarError(f"can't be read at {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup == "head":
            name = m[0].removesuffix("::=").strip()
            if name in rules:
                raise GrammarError(f"{name} is defined twice")
            rules[name] = []
        elif m.lastgroup:
            if name is None:
                raise GrammarError(f"{m[0]!r} is in no rule")
            rules[name].append((m.lastgroup, m[0]))
    return rules


def compiled(text: str, root: str = "root") -> str:
    """One expression, anchored at both ends, for what the grammar's root gives."""
    rules, done = productions(text), {}

    def rule(name: str, above: tuple[str, ...]) -> str:
        if name not in rules:
            raise GrammarError(f"{name} is not defined")
        if name in above:
            raise GrammarError(f"{name} refers to itself")
        if name not in done:
            pieces, depth, out = rules[name], 0, ""
            if not pieces:
                raise GrammarError(f"{name} is empty")
            for k, (kind, piece) in enumerate(pieces):
                if kind == "literal":
                    out += f"(?:{quoted(unescaped(piece[1:-1]))})"
                elif kind == "set":
                    out += character_class(piece[1:-1])
                elif kind == "name":
                    out += rule(piece, (*above, name))
                elif kind == "mark":
                    if k == 0 or pieces[k - 1][0] == "mark" or pieces[k - 1][1] in ("(", "|"):
                        raise GrammarError(f"{piece} repeats nothing in {name}")
                    out += piece
                else:
                    depth += (piece == "(") - (piece == ")")
                    out += {"(": "(?:", ".": r"(?s:.)"}.get(piece, piece)
                if depth < 0:
                    break
            if depth:
                raise GrammarError(f"brackets don't match in {name}")
            done[name] = f"(?:{out})"
        return done[name]

    return rf"^{rule(root, ())}\z"


def read_grammar(spark: SparkSession, path: str, fallback: str, root: str = "root") -> str:
    """The expression of a grammar file; `fallback` only if there is no such file. One that is there but can't be compiled is an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return fallback
    found = files.read_whole(spark, path).select("value").first()
    return compiled(found["value"] if found else "", root)


def conforms(raw: Column, expression: str) -> Column:
    """Is a response a sentence of the grammar, from end to end? Null is none."""
    return F.coalesce(raw.rlike(expression), F.lit(False))
