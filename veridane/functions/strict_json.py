"""A strict decoder of JSON objects in column expressions: a pushdown automaton over a text's tokens.

What it takes is what common strict decoders take: no single quotes, no trailing
commas, no control characters in strings, no numbers with leading zeros or a plus
sign; NaN, Infinity and -Infinity are numbers; a key may stand twice. Depth, digits and
the length of keys have no limit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridane.functions.folds import folded
from veridane.functions.text import bound

#: A well-formed string; a mark; white space; a run of all else; a quote that begins no well-formed string.
STRING = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+"'
TOKEN = STRING + r'|[{}\[\]:,]|[ \t\n\r]++|[^"{}\[\]:, \t\n\r]++|"'
NUMBER = r"^-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][-+]?[0-9]++)?\z"
#: Literals, and the numbers that have names.
LITERALS, NAMED = ("true", "false", "null"), ("NaN", "Infinity", "-Infinity")

#: What may come next: a value; a value or the end of an array; a key; a key or the end of an object; a colon; a comma or an end; nothing, as it is wrong.
VALUE, FIRST, KEY, FIRST_KEY, COLON, NEXT, WRONG = "v", "f", "k", "o", ":", "n", "x"
ENTRY = "struct<key:string,truth:boolean>"


def text_of(string: Column) -> Column:
    """The text of a well-formed string token."""
    plain = F.substring(string, F.lit(2), F.length(string) - 2)
    return F.when(F.contains(string, F.lit("\\")), F.get(F.from_json(F.concat(F.lit("["), string, F.lit("]")), "array<string>"), F.lit(0))).otherwise(plain)


def truth_of(token: Column, behind: Column) -> Column:
    """Truth, as Python has it, of the value that begins with a token: empty ones, zero, false and null are not true."""
    integer = ~token.rlike("[.eE]")
    number = F.when(integer, token.rlike("[1-9]")).otherwise(token.try_cast("double") != 0)
    return F.when(F.startswith(token, F.lit('"')), token != '""').when(token == "{", behind != "}").when(token == "[", behind != "]").when(token.isin("true", *NAMED), F.lit(True)).when(token.isin("false", "null"), F.lit(False)).otherwise(number)


def object_entries(text: Column) -> Column:
    """Entries (key, truth of the value) of a JSON object, in their order, repeated keys included; null for a text that is no object."""
    blank = lambda t: t.rlike(r"^[ \t\n\r]")

    def scanned(tokens: Column) -> Column:
        def step(s, token: Column):
            at, want, stack = s["at"], s["want"], s["stack"]
            top = F.substring(stack, F.length(stack), F.lit(1))
            string, opens = F.startswith(token, F.lit('"')) & (F.length(token) > 1), token.isin("{", "[")
            value = opens | string | token.isin(*LITERALS, *NAMED) | token.rlike(NUMBER)
            takes_value = want.isin(VALUE, FIRST) & value
            takes_key = want.isin(KEY, FIRST_KEY) & string
            closes = ((token == "}") & (top == F.lit(b"{")) & want.isin(NEXT, FIRST_KEY)) | ((token == "]") & (top == F.lit(b"[")) & want.isin(NEXT, FIRST))
            comma = (token == ",") & (want == NEXT) & (F.length(stack) > 0)
            after = (
                F.when(takes_value, F.when(token == "{", FIRST_KEY).when(token == "[", FIRST).otherwise(NEXT))
                .when(takes_key, COLON)
                .when((want == COLON) & (token == ":"), VALUE)
                .when(closes, NEXT)
                .when(comma, F.when(top == F.lit(b"{"), KEY).otherwise(VALUE))
                .otherwise(WRONG)
            )
            # The stack is a string of bytes, so a push or pop copies it at most once.
            moved = F.when(takes_value & opens, F.concat(stack, token.cast("binary"))).when(closes, F.substring(stack, F.lit(1), F.length(stack) - 1)).otherwise(stack)
            outer = F.length(stack) == 1
            key = F.when(takes_key & outer, token).otherwise(s["key"])
            entry = F.struct(s["key"].alias("key"), truth_of(token, F.get(tokens, at + 1)).alias("truth"))
            # Only the outer object's own values stand right behind one of its keys.
            held = F.when(takes_value & outer & (want == VALUE) & (top == F.lit(b"{")), entry)
            return {"at": at + 1, "want": F.when(want == WRONG, want).otherwise(after), "stack": moved, "key": key}, held

        start = {"at": F.lit(0), "want": F.lit(VALUE), "stack": F.lit(b""), "key": F.lit(None).cast("string")}
        done = lambda s, entries: F.when((s["want"] == NEXT) & (F.length(s["stack"]) == 0), entries)
        return F.when(F.get(tokens, F.lit(0)) == "{", folded(tokens, start, step, ENTRY, done))

    entries = bound(F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: ~blank(t)), scanned)
    return F.transform(entries, lambda e: F.struct(text_of(e["key"]).alias("key"), e["truth"].alias("truth")))
