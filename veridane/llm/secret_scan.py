"""Secret scan by sliding-window entropy, with DataFrame functions only.

1. *Base.* Three expressions find assignments to named secrets, access keys and
   runs of hex digits, leftmost and without overlaps; a match that is too short is
   dropped, though what it covered is not searched again.
2. *Candidates.* Runs of at least ``WINDOW`` characters of ``ALPHABET`` with a digit
   and a letter, unless the allow-list suppresses them: forms that are public
   (UUIDs, labelled digests), placeholders, alphabets in order, identifiers and
   paths made of words, and values of the caller's own.
3. *Entropy.* A window slides along a candidate. The counts of its characters are
   a string with a place for each of the alphabet; one character leaves, one
   enters, and the sum of c log2 c changes by two entries of a table each, in
   whole numbers of 2**-20, so sums are exact wherever the window stands. The
   window's class is the narrowest that holds all its characters (hex digits;
   digits and letters of one case; any), and each class has its own threshold.
   A window with a digit and a letter that reaches it is a hit.
4. *Spans.* A candidate with hits gives a span from its first hit's start to its
   last hit's end, of the first hit's class. One that meets a base span confirms
   it and adds nothing; the others are added.

Scale: narrow. All is row-local in the JVM: no shuffle, no state, no broadcast; a
row lost with its executor is a row scanned again. Expressions are linear in a
text's length; places are running sums, made in chunks; spans and candidates are
compared by one sweep over both.

Edge cases: null and empty texts have no spans: counts of 0, the digest of an
empty string, and an empty list; an empty table gives an empty result; repeated
rows and null ids are treated each; ties of start go by the order of kinds;
places are code points; texts of any length are scanned whole; other columns,
whatever their names, are left out of the query and kept by `scan`.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")
#: The method's own kinds, by class of characters.
CLASSES = ("entropy-hex", "entropy-alnum", "entropy-any")
KINDS = (*BASE, *CLASSES)

NAMED = r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*+[:=]\x20*+[\x22\x27]?"
ASSIGN = rf"(?=[aApPsStT]){NAMED}[A-Za-z0-9+/_.=-]++"
#: Of a run only the first AKIA can be long enough if any is, and runs of hex digits are whole, so lengths stand in the expressions.
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
LEAST_VALUE = 12

ALPHABET = string.digits + string.ascii_lowercase + string.ascii_uppercase + "+/=_-"
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/=_-]{{{WINDOW},}}+"
#: Bits a character that a window of a class must reach; random ones of 20 characters miss them one time in a hundred.
BITS = (2.9, 3.4, 3.65)

#: Forms that are public or placeholders.
ALLOWED = (
    r"^(?:uuid[=_-])?[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^(?i:md5|sha1|sha224|sha256|sha384|sha512)[-_=/]",
    r"(?i:example|placeholder|changeme|dummy|sample|redacted|your[-_])",
    r"(?i:abcdefghij|klmnopqrst|qrstuvwxyz|0123456789|1234567890|9876543210)",
)
#: Words of identifiers and paths; a candidate of which they leave a fifth or less is made of words. Short ones count only in mixed case or between separators.
WORDS, LONG_WORDS = r"[A-Z]?[a-z]{2,}+|[A-Z]{3,}+|[/=_-]", r"[a-z]{5,}+|[A-Z]{5,}+"
PARTED = r"[/=_-]|[a-z][A-Z]"

let: Callable[[Column, Callable[[Column], Column]], Column] = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

SPAN = "struct<start:bigint,kind:int,stop:bigint>"
FOUND = "array<struct<start:bigint,stop:bigint,m:string>>"
SCALE = 1 << 20
TERMS = [round(c * math.log2(c) * SCALE) if c else 0 for c in range(WINDOW + 1)]
LIMITS = [math.floor(WINDOW * (math.log2(WINDOW) - bits) * SCALE) for bits in BITS]


def running(steps: Column) -> Column:
    """Running sums of an array of longs, in chunks of about the root of its size, so lists that grow stay short."""
    longs = "array<bigint>"

    def step(s: Column, x: Column) -> Column:
        return F.named_struct(F.lit("sum"), s["sum"] + x, F.lit("sums"), F.concat(s["sums"], F.array(s["sum"] + x)))

    def chunk(s: Column, part: Column) -> Column:
        start = F.named_struct(F.lit("sum"), s["sum"], F.lit("sums"), F.array().cast(longs))
        return let(F.aggregate(part, start, step), lambda r: F.named_struct(F.lit("sum"), r["sum"], F.lit("lists"), F.concat(s["lists"], F.array(r["sums"]))))

    def whole(steps: Column, width: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / width).cast("int")), lambda k: F.slice(steps, k * width + 1, width))
        start = F.named_struct(F.lit("sum"), F.lit(0).cast("long"), F.lit("lists"), F.array().cast(f"array<{longs}>"))
        return F.aggregate(parts, start, chunk, lambda s: F.flatten(s["lists"]))

    return let(steps, lambda x: F.when(F.size(x) > 0, let(F.ceil(F.sqrt(F.size(x))).cast("int"), lambda width: whole(x, width))).otherwise(F.array().cast(longs)))


def found(text: Column, pattern: str) -> Column:
    """(start, stop, m) of each match in turn; a text without one isn't cut up."""

    def placed(ms: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(ms))
        stops = running(F.zip_with(gaps, ms, lambda g, m: (g + F.length(m)).cast("long")))
        return F.zip_with(stops, ms, lambda stop, m: F.struct((stop - F.length(m)).alias("start"), stop.alias("stop"), m.alias("m")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda ms: F.when(F.size(ms) > 0, placed(ms)).otherwise(F.array().cast(FOUND)))


def spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["stop"].alias("stop")))


def base_spans(text: Column) -> Column:
    """Sorted spans of the three base kinds."""
    long_enough = lambda x: F.length(F.regexp_replace(x["m"], f"^{NAMED}", "")) >= LEAST_VALUE
    none = F.array().cast(FOUND)
    assign = F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), F.filter(found(text, ASSIGN), long_enough)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), found(text, ACCESS)).otherwise(none)
    return F.sort_array(F.concat(spans(assign, 0), spans(access, 1), spans(found(text, HEX), 2)))


def suppressed(candidate: Column, values: tuple[str, ...]) -> Column:
    """Is a candidate on the allow-list?"""
    left = F.when(candidate.rlike(PARTED), F.regexp_replace(candidate, WORDS, "")).otherwise(F.regexp_replace(candidate, LONG_WORDS, ""))
    out = F.length(left) * 5 <= F.length(candidate)
    if values:
        out = out | candidate.isin(*values)
    for form in ALLOWED:
        out = out | candidate.rlike(form)
    return out


def entropy_hit(candidate: Column) -> Column:
    """STRUCT(first, last, class): places from 0 of the first hit's start and the last hit's end, or null."""
    table = F.array(*[F.lit(t).cast("long") for t in TERMS])
    at = lambda c: F.instr(F.lit(ALPHABET), c)

    def moved(w: Column, place: Column, by: int) -> Column:
        """Counts and sum with one character more or less; a count c is the character with code 48 + c."""
        count = F.ascii(F.substring(w["counts"], place, F.lit(1))) - 48
        return let(count, lambda c: F.struct(F.overlay(w["counts"], F.char((c + (48 + by)).cast("long")), place).alias("counts"), (w["sum"] + F.get(table, c + by) - F.get(table, c)).alias("sum")))

    def along(chars: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            c = F.get(chars, i)
            left = F.when(i >= WINDOW, let(at(F.get(chars, i - WINDOW)), lambda p: moved(s, p, -1))).otherwise(F.struct(s["counts"].alias("counts"), s["sum"].alias("sum")))

            def entered(w: Column, p: Column) -> Column:
                # Places in the alphabet: digits to 10, lower case to 36, upper case to 62.
                digit, lower, upper = p <= 10, (p > 10) & (p <= 36), (p > 36) & (p <= 62)
                run = lambda name, holds: F.when(holds, s[name] + 1).otherwise(0)
                fields = {"counts": w["counts"], "sum": w["sum"], "hex": run("hex", digit | (p <= 16) | upper & (p <= 42)), "low": run("low", digit | lower), "up": run("up", digit | upper), "digit": F.when(digit, i).otherwise(s["digit"]), "letter": F.when(lower | upper, i).otherwise(s["letter"])}
                return judged(F.struct(*[x.alias(k) for k, x in fields.items()]))

            def judged(t: Column) -> Column:
                def out(t: Column, kind: Column) -> Column:
                    limit = F.get(F.array(*[F.lit(x).cast("long") for x in LIMITS]), kind)
                    hit = (i >= WINDOW - 1) & (t["digit"] > i - WINDOW) & (t["letter"] > i - WINDOW) & (t["sum"] <= limit)
                    new = hit & s["first"].isNull()
                    marks = {"first": F.when(new, i - WINDOW + 1).otherwise(s["first"]), "last": F.when(hit, i + 1).otherwise(s["last"]), "class": F.when(new, kind).otherwise(s["class"])}
                    return F.struct(*[t[k].alias(k) for k in ("counts", "sum", "hex", "low", "up", "digit", "letter")], *[x.alias(k) for k, x in marks.items()])

                return let(t, lambda t: let(F.when(t["hex"] >= WINDOW, 0).when((t["low"] >= WINDOW) | (t["up"] >= WINDOW), 1).otherwise(2), lambda k: out(t, k)))

            return let(left, lambda w: let(at(c), lambda p: let(moved(w, p, 1), lambda v: entered(v, p))))

        none = F.lit(None).cast("int")
        start = F.struct(F.lit("0" * len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("sum"), *[F.lit(0).alias(k) for k in ("hex", "low", "up")], *[F.lit(-1).alias(k) for k in ("digit", "letter")], *[none.alias(k) for k in ("first", "last", "class")])
        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, lambda s: F.when(s["first"].isNotNull(), F.struct(s["first"].alias("first"), s["last"].alias("last"), s["class"].alias("class"))))

    return let(F.split(candidate, ""), along)


def entropy_spans(text: Column, values: tuple[str, ...]) -> Column:
    """Sorted spans of candidates with a hit; two never overlap."""
    fit = lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]") & ~suppressed(x["m"], values)

    def one(x: Column) -> Column:
        return let(entropy_hit(x["m"]), lambda h: F.when(h.isNotNull(), F.struct((x["start"] + h["first"]).alias("start"), (h["class"] + len(BASE)).alias("kind"), (x["start"] + h["last"]).alias("stop"))))

    return F.filter(F.transform(F.filter(found(text, CANDIDATE), fit), one), lambda h: h.isNotNull())


def meets(mine: Column, others: Column) -> Column:
    """For each of some spans, sorted and apart from each other: does it overlap any of the others?

    As many others overlap a span as begin before its end, less those that end by
    its start: two running counts along one sorted list of all ends.
    """
    event = lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("kind"))
    ends = F.concat(F.transform(others, lambda x: event(x["stop"], 0)), F.transform(mine, lambda x: event(x["start"], 1)), F.transform(mine, lambda x: event(x["stop"], 2)), F.transform(others, lambda x: event(x["start"], 3)))

    def counted(events: Column) -> Column:
        def upto(mark: int, kind: int) -> Column:
            sums = running(F.transform(events, lambda e: (e["kind"] == kind).cast("long")))
            both = F.zip_with(events, sums, lambda e, n: F.struct(e["kind"].alias("kind"), n.alias("n")))
            return F.transform(F.filter(both, lambda b: b["kind"] == mark), lambda b: b["n"])

        return F.zip_with(upto(2, 3), upto(1, 0), lambda begun, ended: begun > ended)

    return let(F.sort_array(ends), counted)


def scan(docs: DataFrame, text_col: str = "text", allow: tuple[str, ...] = ()) -> DataFrame:
    """docs with `base` and `added`, sorted arrays of (start, kind, stop), and `confirmed`, the number of base spans' candidates with a hit. allow: values that are no secrets. Columns of docs with one of these names are replaced."""
    text = F.coalesce(F.col(f"c{docs.columns.index(text_col)}"), F.lit(""))

    def judged(base: Column, high: Column) -> Column:
        pick = lambda met, want: F.transform(F.filter(F.arrays_zip(high.alias("s"), met.alias("met")), lambda x: x["met"] == want), lambda x: x["s"])
        out = lambda added, confirmed: F.struct(base.alias("base"), added.alias("added"), confirmed.cast("long").alias("confirmed"))
        none = F.array().cast(f"array<{SPAN}>")
        swept = let(meets(high, base), lambda met: out(pick(met, F.lit(False)), F.size(pick(met, F.lit(True)))))
        return F.when(F.size(high) == 0, out(none, F.lit(0))).when(F.size(base) == 0, out(high, F.lit(0))).otherwise(swept)

    verdict = let(base_spans(text), lambda b: let(entropy_spans(text, allow), lambda h: judged(b, h)))
    kept = [k for k, c in enumerate(docs.columns) if c not in ("base", "added", "confirmed")]
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).withColumn("verdict", F.explode(F.array(verdict)))
    return numbered.select(*[F.col(f"c{k}").alias(docs.columns[k]) for k in kept], "verdict.*")


def shown(found_spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found_spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: counts and digest of base spans, all spans, and how many were added and confirmed."""
    found_ = scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", allow)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    every = F.sort_array(F.concat("base", "added"))
    return found_.select(F.col("id").alias(id_col), *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(every).alias("spans"), F.size("added").cast("long").alias("n_added"), F.col("confirmed").alias("n_confirmed"))
