"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

1. *Scan.* One pass finds, in whole texts, the matches of four base expressions
   (e-mail, IP, card, phone), values of named secrets (``token = "..."`` and a few
   public key formats), and all identifier-like words (with a digit or @) with
   the words around them. A match's place, in characters and in bytes, comes from
   the lengths of the pieces between matches, summed along the document
   afterwards. The expressions are possessive or start only where the last match
   ended, so they are linear in a text's length and never recurse.
2. *Mentions.* A base span or a secret that begins in an identifier-like word is a
   seed. Of the other such words, numbers in a row, one space apart, are one
   candidate as a whole (``555 100 2000``), but for one that alone is a base match
   and passes its check; a word that a span touches is none, so there are no pieces
   of spans. Marks and a name with = : or # before a candidate
   (``tel:``) belong to its context. A candidate that in itself is a base match
   and passes its check is a seed too: a match that a neighbour had run into.
3. *Patterns.* Three lexical contexts of a mention, from the words around it in
   lower case, without marks at their ends, with 0 for digits, and with = : # as
   words of their own: the two units before it; the unit before and the word
   behind; the unit before and the mention's own shape. <s> and </s> stand for
   words beyond the text's ends, digests for long words. Pattern-instance pairs
   make a graph.
4. *Rounds.* A pattern's score for a kind is the sum of its instances' scores
   for it over its number of distinct instances plus one. An instance's score
   is 1 for a seed, else the best score of its patterns among the kinds that its
   form allows. In each round a pattern counts if at least ``support`` of its
   distinct instances are seeds of the kind or have reached ``confidence``, so
   discoveries can induce patterns. ``rounds`` times.
5. *Discovery.* Candidates whose best pattern reaches ``confidence`` become spans
   of that kind, if their form allows the kind (`allowed`): what fails a base
   kind's own check is never of that kind.

Scale: texts are read once; what is kept are places and words, in a table in
the shared folder. Copies count once as pairs are distinct. Sums combine before
their shuffles; joins are between written tables, so Spark can split hot patterns.

Edge cases: null text is empty; no span gives an empty string and its digest; an
empty table gives an empty result; rows that repeat are treated each, also with
null ids; texts of any length are scanned whole; of equal scores the later kind
of KINDS wins; other columns, whatever their names, are left out of the query and
kept as they are by `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridane.llm.shared import written

#: Kinds in their order, and the base patterns in linear form.
BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The method's own kind comes behind the base ones; TOKEN_KIND marks identifier-like words.
KINDS = (*BASE, "secret")
SECRET, TOKEN_KIND = 4, 5
#: A text without this has no match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Names of secrets, and public formats of keys.
SECRET_NAME = r"(?:access[_-]?key|api[_-]?key|auth[_-]?key|credential|passwd|password|private[_-]?key|pwd|secret|token)s?"
KEY_FORMATS = r"(?:AKIA|ASIA)(?=[A-Z]{0,15}[0-9])[0-9A-Z]{16}|gh[opsu]_(?=[A-Za-z]{0,35}[0-9])[A-Za-z0-9]{36}|xox[abprs]-(?=[A-Za-z-]{0,200}[0-9])[A-Za-z0-9-]{10,}+|eyJ(?=[A-Za-z_.-]{0,200}[0-9])[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"
NAMED = rf"(?i:{SECRET_NAME})[\x22\x27]?[\x20\t]*+[:=][\x20\t]*+[\x22\x27]?"
#: A value holds a digit, wherever. A run without one is skipped but for its last part, which may name the next value, so it is not read anew for each name in it.
SKIPPED = r"(?![A-Za-z+/=_.-]*+[0-9])(?:[A-Za-z_-]*+[+/=.](?=[A-Za-z+/=_.-]))++"
VALUE = rf"(?:(?=[A-Za-z+/=_.-]*+[0-9])[A-Za-z0-9+/=_.-]{{16,}}+|{SKIPPED})"
SECRETS = rf"(?<![A-Za-z0-9]){NAMED}{VALUE}|(?<![A-Za-z0-9])(?:{KEY_FORMATS})"
SECRETS_NEED = r"[:=]|AKIA|ASIA|gh[opsu]_|xox|eyJ"

TOKEN = r"(?<![^\x20\x09-\x0D])(?=[^0-9@\x20\x09-\x0D]*+[0-9@])[^\x20\x09-\x0D]++"
#: Before a candidate: marks, a name with = or : or #, and marks; behind it: marks.
MARKS_BEFORE = r"(?:[\[<{\x22\x27]|\((?![0-9+]+\).))*+"
LABEL = r"(?:[A-Za-z][A-Za-z_-]{1,40}+[\x22\x27]?[:=#]++)?+"
HEAD = rf"^{MARKS_BEFORE}{LABEL}{MARKS_BEFORE}"
TAIL = r"(?<![.,;:!?)\]>}\x22\x27*$%&#])[.,;:!?)\]>}\x22\x27*$%&#]++$"
#: A number without letters; one that may begin a run, with a label; one that ends a run.
DIGITS = r"[(+]*+[0-9][0-9()/.+-]*+[.,;:!?]*+$"
NUMBER, FIRST_NUMBER, LAST_NUMBER = f"^{DIGITS}", f"{HEAD}{DIGITS}", r"[.,;:!?]$"
LONG = 64
SPACES = r"[\x20\x09-\x0D]+"
#: A text's first word, and its last two in a reversed text.
FIRST = r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)"
LAST_TWO = r"^[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)?+"
SPAN = "struct<start:bigint,kind:int,stop:bigint>"


def word_of(w: Column) -> Column:
    """A word as the scan holds it: in lower case, long ones as digests."""
    w = F.lower(w)
    return F.when(F.length(w) > LONG, F.md5(w)).otherwise(w)


def last_two(text: Column) -> Column:
    """Array of a text's last two words, or of as many as there are."""
    words = F.split(F.reverse(F.regexp_extract(F.reverse(text), LAST_TWO, 0)), SPACES)
    return F.transform(F.filter(words, lambda w: w != ""), word_of)


def pieces(text: Column, pattern: str, contexts: bool) -> Column:
    """Structs of each match in order: characters and bytes of the text before it back to the last match, the match, and on demand whether that text is one space, and the nearest words between it and the matches around."""
    parts = F.split(text, pattern, -1)
    zipped = F.arrays_zip(parts.alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.slice(parts, 2, F.size(parts)).alias("h"))

    def one(x: Column) -> Column:
        fields = [F.lit("gap"), F.length(x["g"]), F.lit("bytes"), F.octet_length(x["g"]), F.lit("m"), x["m"]]
        if contexts:
            fields += [F.lit("near"), x["g"] == " ", F.lit("before"), last_two(x["g"]), F.lit("behind"), F.nullif(word_of(F.regexp_extract(x["h"], FIRST, 1)), F.lit(""))]
        return F.named_struct(*fields)

    return F.filter(F.transform(zipped, one), lambda x: x["m"].isNotNull())


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: Column, m: Column) -> Column:
    """Does a match pass its kind's check?"""
    n = F.length(digits_of(m))
    part = lambda k: F.regexp_replace(F.get(F.split(m, r"\."), F.lit(k)), "^0+", "")
    byte = lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255")
    ip = byte(part(0)) & byte(part(1)) & byte(part(2)) & byte(part(3))
    return F.when(kind == 0, F.lit(True)).when(kind == 1, ip).when(kind == 2, (n >= 14) & (n <= 19) & F.call_function("luhn_check", digits_of(m))).when(kind == 3, (n >= 10) & (n <= 15)).when(kind == SECRET, n > 0).otherwise(F.lit(True))


def whole(m: Column) -> Column:
    """The base kind of which a text is a match from end to end that passes the check; else null."""
    out = F.lit(None).cast("int")
    for k in range(len(BASE) - 1, -1, -1):
        pattern = PATTERNS[BASE[k]].replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", "").replace(r"(?:\G|(?<![0-9]))", "")
        out = F.when(m.rlike(f"^{pattern}$") & valid(F.lit(k), m), k).otherwise(out)
    return out


def allowed(m: Column) -> Column:
    """Array of the kinds that a candidate's form allows; a base match that failed its check is not of its kind."""
    digits = F.length(digits_of(m))
    forms = (
        m.rlike(r"^[^@]+(?:@|\(at\)|\[at\])[^@]+$"),
        m.rlike(r"^(?=[^:]*:[^:]*:)[0-9A-Fa-f:.]+$") | m.rlike(r"^[0-9]{1,3}(?:\[\.\][0-9]{1,3}|\(\.\)[0-9]{1,3}|\.[0-9]{1,3}){3}$") & ~m.rlike(r"^[0-9.]+$"),
        m.rlike(r"^[0-9][0-9 ./_-]+[0-9]$") & ~m.rlike(r"^[0-9](?:[ -]?[0-9])++$") & (digits >= 12) & (digits <= 19) & F.call_function("luhn_check", F.when(digits > 0, digits_of(m)).otherwise("1")),
        m.rlike(r"^[0-9+(][0-9()+ ./-]+[0-9]$") & ~m.rlike(r"^[0-9]++(?:\.[0-9]++)++$") & ~m.rlike(r"^\+[0-9][ ().0-9-]+[0-9]$") & ~m.rlike(r"^[0-9]{14,}$") & (digits >= 6) & (digits <= 15),
        m.rlike(r"^[^ ]{8,}$") & ~m.contains("@") & m.rlike(r"[A-Za-z]") & ~m.rlike(r"^[A-Za-z]+[0-9]{1,4}$"),
    )
    return F.array_compact(F.array(*[F.when(f, k) for k, f in enumerate(forms)]))


def of_kind(k: int):
    """A piece with its kind; all but words get empty contexts."""
    around = k == TOKEN_KIND

    def one(x: Column) -> Column:
        near, before, behind = (x["near"], x["before"], x["behind"]) if around else (F.lit(False), F.lit(None).cast("array<string>"), F.lit(None).cast("string"))
        return F.named_struct(F.lit("kind"), F.lit(k), F.lit("gap"), x["gap"], F.lit("bytes"), x["bytes"], F.lit("m"), x["m"], F.lit("near"), near, F.lit("before"), before, F.lit("behind"), behind)

    return one


def count_of(k: int, found: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == k)).cast("long")


def scan(rows: DataFrame) -> DataFrame:
    """rows (row, text, ...) without text, with `found`: all matches; see `pieces`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    with_digit = text.rlike("[0-9@]")
    empty = "array<struct<kind:int,gap:int,bytes:int,m:string,near:boolean,before:array<string>,behind:string>>"
    found = []
    for k, kind in enumerate(BASE):
        need = with_digit & F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else with_digit
        own = F.transform(pieces(text, PATTERNS[kind], False), of_kind(k))
        found.append(F.when(need, own).otherwise(F.array().cast(empty)))
    secrets = F.transform(pieces(text, SECRETS, False), of_kind(SECRET))
    found.append(F.when(with_digit & text.rlike(SECRETS_NEED), secrets).otherwise(F.array().cast(empty)))
    tokens = F.transform(pieces(text, TOKEN, True), of_kind(TOKEN_KIND))
    found.append(F.when(with_digit, tokens).otherwise(F.array().cast(empty)))
    return rows.withColumn("found", F.concat(*found)).drop("text")


def places(scanned: DataFrame) -> DataFrame:
    """(row, kind, start, stop, first_byte, last_byte, m, near, left, right): valid base spans, secrets and words, with places in code points and bytes, and for words the two words before and the word behind."""
    each = scanned.select("row", F.posexplode("found").alias("i", "f")).select("row", "i", "f.*")
    order = Window.partitionBy("row", "kind").orderBy("i")
    along = order.rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap").cast("long") + F.length("m")).over(along)
    last_byte = F.sum(F.col("bytes").cast("long") + F.octet_length("m")).over(along)
    # Between two identifier-like words lie only other words, so two of them back is far enough.
    token = F.when(F.col("kind") == TOKEN_KIND, word_of(F.col("m")))
    back = lambda k: F.coalesce(F.array(F.lag(token, k).over(order)), F.array())
    words = F.concat(F.array(F.lit("<s>"), F.lit("<s>")), back(2), F.coalesce(F.lag("before", 1).over(order), F.array().cast("array<string>")), back(1), F.col("before"))
    left = F.filter(words, lambda w: w.isNotNull())
    right = F.when(F.col("kind") == TOKEN_KIND, F.coalesce("behind", F.lead(token, 1).over(order), F.lit("</s>")))
    # A secret's span is its value, without its name.
    name = F.when(F.col("kind") == SECRET, F.regexp_extract("m", f"^{NAMED}", 0)).otherwise("")
    placed = each.withColumns({"stop": stop, "last_byte": last_byte, "words": left, "right": right, "m": F.substring("m", F.length(name) + 1, F.length("m"))})
    placed = placed.withColumns({"start": F.col("stop") - F.length("m"), "first_byte": F.col("last_byte") - F.octet_length("m")})
    return placed.filter(valid(F.col("kind"), F.col("m"))).select("row", "kind", "start", "stop", "first_byte", "last_byte", "m", "near", F.slice("words", -2, 2).alias("left"), "right")


def cue(w: Column) -> Column:
    """A word of a context, made general: without marks at its ends, digits as 0; one of marks alone as it is."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(w, r"^[(\[{\x22\x27]++", ""), r"(?<![.,;!?)\]}\x22\x27])[.,;!?)\]}\x22\x27]++$", ""), "[0-9]+", "0")
    return F.when(bare == "", w).otherwise(bare)


def units(w: Column) -> Column:
    """A word as one or two units: = : # at its end stand apart."""
    plain, mark = F.regexp_extract(w, r"^(.*?)[\x22\x27]?([:=#]+)$", 1), F.regexp_extract(w, r"([:=#]+)$", 1)
    return F.when((mark != "") & (plain != ""), F.array(cue(plain), mark)).otherwise(F.array(cue(w)))


def shape(m: Column) -> Column:
    """Runs of digits as 9, of letters as a; long and mixed ones as x."""
    s = F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), "[A-Za-z]+", "a")
    return F.when(F.length(s) > 16, "x").otherwise(s)


def mentions(placed: DataFrame) -> DataFrame:
    """(row, start, stop, first_byte, last_byte, instance, kind, own, kinds, patterns) of each seed and candidate.

    kind is the seed's, else null; own says that the seed is no base span or secret yet; kinds are what a candidate's form allows.
    """
    # Spans come twice, where they begin and at their last character, to meet both words.
    is_token = F.col("kind") == TOKEN_KIND
    ends = F.when(is_token, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    met = placed.withColumn("end", F.explode(ends)).withColumn("at", F.when(F.col("end"), F.col("stop") - 1).otherwise(F.col("start")))
    along = Window.partitionBy("row").orderBy("at", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    token = F.last(F.when(is_token, F.struct("start", "stop", "right")), ignorenulls=True).over(along)
    reach = F.max(F.when(~is_token, F.col("stop"))).over(along)
    begun = lambda c: F.max(F.when(~F.col("end"), F.col(c)))
    both = met.withColumns({"token": token, "reach": reach}).groupBy("row", "kind", "start")
    both = both.agg(
        *[begun(c).alias(c) for c in ("m", "left", "reach", "near", "first_byte")],
        F.max(F.when(~F.col("end"), F.struct("token.start", "token.stop"))).alias("holder"),
        F.max(F.when(is_token | F.col("end"), F.col("token.right"))).alias("right"),
    )
    # One row a word: the first span that begins in it, or the word itself.
    seed = F.min(F.when(~is_token, F.struct("start", "kind", "m", "right")))
    word = F.max(F.when(is_token, F.struct("m", "left", "right", F.coalesce("reach", F.lit(0)).alias("reach"), "near", "first_byte")))
    words = both.filter(F.col("holder.start").isNotNull()).groupBy("row", "holder").agg(seed.alias("seed"), word.alias("t"))
    # Words that no span touches; numbers among them in a row make one candidate.
    free = F.col("seed").isNull() & (F.col("t.reach") <= F.col("holder.start"))
    number = F.col("free") & F.col("t.m").rlike(NUMBER) & ~F.col("alone")
    order = Window.partitionBy("row").orderBy("holder.start")
    goes_on = F.lag(F.col("free") & ~F.col("alone") & F.col("t.m").rlike(FIRST_NUMBER) & ~F.col("t.m").rlike(LAST_NUMBER)).over(order)
    alone = F.when(F.col("free") & F.col("t.m").rlike(NUMBER), whole(F.regexp_replace("t.m", TAIL, "")).isNotNull()).otherwise(False)
    words = words.withColumn("free", free).withColumn("alone", alone).withColumn("joined", F.coalesce(number & F.col("t.near") & goes_on, F.lit(False)))
    words = words.withColumn("run", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(order)).filter(F.col("free") | F.col("seed").isNotNull())
    runs = words.groupBy("row", "run").agg(
        F.min(F.struct("holder.start", "t.m", "t.left", "t.first_byte", "seed")).alias("a"),
        F.max(F.struct("holder.start", "t.right")).alias("z"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("holder.start", "t.m"))), lambda w: w["m"]), " ").alias("m"),
    )
    head = F.regexp_extract("m", HEAD, 0)
    runs = runs.withColumn("head", F.when(F.col("a.seed").isNull(), head).otherwise(F.substring("a.m", F.lit(1), (F.col("a.seed.start") - F.col("a.start")).cast("int"))))
    runs = runs.withColumn("tail", F.when(F.col("a.seed").isNull(), F.regexp_extract(F.regexp_replace("m", HEAD, ""), TAIL, 0)).otherwise(""))
    bare = F.substring("m", F.length("head") + 1, F.length("m") - F.length("head") - F.length("tail"))
    runs = runs.withColumn("text", F.coalesce("a.seed.m", bare)).filter(F.length("text") > 0).withColumn("own", F.when(F.col("a.seed").isNull(), whole(F.col("text"))))
    # The name before a candidate in its own word is its nearest context.
    name = F.regexp_replace(F.lower("head"), r"^[(\[<{\x22\x27]++|[\x22\x27(\[<{]++$", "")
    before = F.flatten(F.transform(F.concat(F.col("a.left"), F.when(F.length(name) > 0, F.array(name)).otherwise(F.array().cast("array<string>"))), units))
    runs = runs.withColumn("u", F.slice(before, -2, 2))
    u2, u1 = F.get("u", F.lit(0)), F.get("u", F.lit(1))
    patterns = F.array(F.concat_ws(" ", F.lit("2"), u2, u1), F.concat_ws(" ", F.lit("1"), u1, F.lit("_"), cue(F.coalesce("a.seed.right", "z.right"))), F.concat_ws(" ", F.lit("s"), u1, shape(F.col("text"))))
    seeded = F.coalesce("a.seed.kind", "own")
    start, first_byte = F.col("a.start") + F.length("head"), F.col("a.first_byte") + F.octet_length("head")
    return runs.select(
        "row",
        start.alias("start"),
        (start + F.length("text")).alias("stop"),
        first_byte.alias("first_byte"),
        (first_byte + F.octet_length("text")).alias("last_byte"),
        F.when(F.length("text") > LONG, F.md5("text")).otherwise(F.col("text")).alias("instance"),
        seeded.alias("kind"),
        F.col("own").isNotNull().alias("own"),
        F.when(seeded.isNull(), allowed(F.col("text"))).alias("kinds"),
        patterns.alias("patterns"),
    )


def scored_patterns(found: DataFrame, support: int, rounds: int, confidence: float) -> DataFrame:
    """(pattern, kind, score) of the last round."""
    pairs = written(found.select(F.explode("patterns").alias("pattern"), "instance", "kind", "kinds").groupBy("pattern", "instance").agg(F.min("kind").alias("kind"), F.max("kinds").alias("kinds")), "pairs")
    sizes = written(pairs.groupBy("pattern").agg(F.count("*").alias("n")), "sizes")
    seeds = pairs.filter("kind IS NOT NULL").select("pattern", F.col("kind").alias("of"), F.lit(1.0).alias("s"))
    open_ = pairs.filter("kind IS NULL AND size(kinds) > 0").select("pattern", "instance", "kinds")
    known = seeds
    for k in range(rounds):
        # Only patterns with enough seeds or discovered instances of one kind score.
        sums = known.groupBy("pattern", "of").agg(F.sum("s").alias("total"), F.count_if(F.col("s") >= confidence).alias("lent")).filter(F.col("lent") >= support)
        scores = written(sums.join(sizes, "pattern").select("pattern", "of", (F.col("total") / (F.col("n") + 1)).alias("score")), "scores")
        if k < rounds - 1:
            best = open_.join(scores, "pattern").filter(F.array_contains("kinds", F.col("of"))).groupBy("instance", "of").agg(F.max("score").alias("s"))
            known = seeds.union(open_.join(written(best, "instances"), "instance").select("pattern", "of", "s"))
    return scores.select("pattern", F.col("of").alias("kind"), "score")


def spans(placed: DataFrame, support: int = 3, rounds: int = 3, confidence: float = 0.6) -> DataFrame:
    """(row, kind, start, stop, first_byte, last_byte, base) of all spans: base matches, secrets, and what good patterns discover."""
    found = written(mentions(placed), "mentions")
    good = written(scored_patterns(found, support, rounds, confidence).filter(F.col("score") >= confidence), "patterns")
    at = ["row", "start", "stop", "first_byte", "last_byte"]
    open_ = found.filter("kind IS NULL AND size(kinds) > 0").select(*at, "kinds", F.explode("patterns").alias("pattern"))
    best = open_.join(good, "pattern").filter(F.array_contains("kinds", F.col("kind"))).groupBy(*at).agg(F.max(F.struct("score", "kind")).alias("b"))
    known = placed.filter(F.col("kind") < TOKEN_KIND).select("row", "kind", *at[1:], (F.col("kind") < len(BASE)).alias("base"))
    own = found.filter("own").select("row", "kind", *at[1:], F.lit(False))
    return known.union(own).union(best.select("row", "b.kind", *at[1:], F.lit(False)))


def numbered(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The scan of docs with a row number, written once; the columns `keep` go along."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    return written(scan(rows), "scan")


def shown(found: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 3, rounds: int = 3, confidence: float = 0.6) -> DataFrame:
    """A row for each document: counts and digest of base spans, all spans, their number, and the secrets among them."""
    scanned = numbered(docs, text_col, [id_col])
    placed = written(places(scanned), "places")
    found = spans(placed, support, rounds, confidence)
    one = F.struct("start", "kind", F.col("stop"))
    marks = found.select("row", F.lit(None).cast("long").alias("id"), F.lit(False).alias("doc"), one.alias("s"), "base")
    heads = scanned.select("row", F.col("k0").alias("id"), F.lit(True).alias("doc"), F.lit(None).cast(SPAN).alias("s"), F.lit(False).alias("base"))
    each = heads.union(marks).groupBy("row").agg(F.max("id").alias("id"), F.array_sort(F.collect_list(F.when(F.col("base"), F.col("s")))).alias("of_base"), F.array_sort(F.collect_list("s")).alias("all"))
    counts = [count_of(k, "of_base").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return each.select(F.col("id").alias(id_col), *counts, F.sha2(shown(F.col("of_base")), 256).alias("base_sha256"), shown(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"), count_of(SECRET, "all").alias("n_secret"))


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", support: int = 3, rounds: int = 3, confidence: float = 0.6) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets, and n_chars, if there, made to fit; columns as they were.

    Spans that overlap go as one, by the name of the first. What stays between
    them is taken from the text's bytes by place, so the cost is linear in the
    text and in its spans.
    """
    names = docs.columns
    numbered_docs = docs.toDF(*[f"c{k}" for k in range(len(names))])
    text = f"c{names.index(text_col)}"
    rows = written(numbered_docs.withColumns({"row": F.monotonically_increasing_id(), "busy": F.coalesce(F.col(text).rlike("[0-9@]"), F.lit(False))}), "rows")
    placed = written(places(written(scan(rows.filter("busy").select("row", F.col(text).alias("text"))), "scan")), "places")
    order = Window.partitionBy("row").orderBy("start", "kind", "stop").rowsBetween(Window.unboundedPreceding, -1)
    cuts = spans(placed, support, rounds, confidence).withColumn("done", F.coalesce(F.max("last_byte").over(order), F.lit(0)))
    cut = F.when(F.col("first_byte") >= F.col("done"), F.struct("start", "done", F.col("first_byte").alias("upto"), "kind"))
    per_row = written(cuts.groupBy("row").agg(F.array_sort(F.collect_list(cut)).alias("cuts"), F.max("last_byte").alias("done")), "cuts")
    # One plan at every size: a merge join of the texts that can hold a span; the others, without a digit or @, aren't shuffled.
    joined = rows.filter("busy").join(per_row.hint("merge"), "row", "left")
    labels = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def clean(raw: Column) -> Column:
        part = lambda a, n: F.substring(raw, (a + 1).cast("int"), n.cast("int")).cast("string")
        kept = F.transform("cuts", lambda c: F.concat(part(c["done"], c["upto"] - c["done"]), F.get(labels, c["kind"])))
        return F.concat(F.array_join(kept, ""), part(F.col("done"), F.octet_length(raw)))

    # The bytes are bound once, so no piece copies the text.
    done = joined.withColumn("clean", F.when(F.col("cuts").isNotNull(), F.get(F.transform(F.array(F.col(text).cast("binary")), clean), F.lit(0))).otherwise(F.col(text)))
    done = done.unionByName(rows.filter("NOT busy").withColumns({"cuts": F.lit(None).cast(per_row.schema["cuts"].dataType), "done": F.lit(None).cast("long"), "clean": F.col(text)}))
    out = []
    for k, name in enumerate(names):
        if name == text_col:
            out.append(F.col("clean").alias(name))
        elif name == chars_col:
            out.append(F.when(F.col("cuts").isNotNull(), F.length("clean").cast(docs.schema[name].dataType)).otherwise(F.col(f"c{k}")).alias(name))
        else:
            out.append(F.col(f"c{k}").alias(name))
    return done.select(*out)
