"""Source divergence audit: how much the sources of a language differ in the words they use, by wide term vectors.

1. *Counts.* Each text's terms are sorted, so a term's first place in a text is
   told by its neighbour; one aggregate by (language, source, term) then gives
   both its occurrences and its documents, without a row for each document.
2. *Vectors.* Each term of a language that is in at least ``least`` of its
   documents is pivoted into an array of counts by source, sources in the order
   of their names.
3. *Probabilities.* p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)), exactly, as
   a long division in base 1000 in whole numbers, for up to 9e15 occurrences.
4. *Pairs.* From each vector, higher-order functions emit a contribution
   floor((p - q)**2 / (p + q)) for each pair of sources of which one has the
   term; sums combine before their shuffle. Terms that neither source has all
   give the same, which is added once, times their number.
5. *Terms.* What a source uses more than its language does, the first ``top``.

Scale: texts are read once and never shuffled; what is shuffled are counts,
combined within each task, so frequent words and large sources are no hot keys.
An array has a place for each source of its language, no more, and a task emits
from one vector and one source at a time. Sources, with their totals, go to every
task if they are at most ``BROADCAST`` (counted); beyond that they are joined.

Edge cases: null texts, languages and sources are empty strings; a group without
terms still gets its pairs, of value 0 if no term of its language is kept; a
language of one source has no pairs; repeated rows are documents each; texts of
any length are taken whole; ties go by the item's UTF-8 bytes; an empty table
gives an empty result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridane.llm.shared import written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST = 1 << 18
GROUP = ["lang", "source"]


def lowered(text: Column) -> Column:
    """text with A-Z alone in lower case. An ASCII text has no other letters, and is lowered at once, not by character."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def term_counts(texts: DataFrame, group: list[str]) -> DataFrame:
    """(*group, term, n, docs) of texts (*group, text): occurrences of each term and documents with it."""
    words = F.sort_array(F.regexp_extract_all(lowered(F.col("text")), F.lit(TERM), F.lit(0)))
    rows = texts.select(*group, words.alias("words"))
    # The outer form, as the plain one would test the words' number first and make them twice.
    each = rows.select(*group, "words", F.posexplode_outer("words").alias("i", "term")).filter(F.col("term").isNotNull())
    first = F.when(F.get("words", F.col("i") - 1) == F.col("term"), 0).otherwise(1)
    return each.select(*group, "term", first.alias("first")).groupBy(*group, "term").agg(F.count("*").alias("n"), F.sum("first").alias("docs"))


def dense(entries: Column, size: Column) -> Column:
    """An array of `size` counts from sorted entries (ix, n), with 0 where there is none."""
    none = F.array().cast("array<bigint>")
    gap = lambda n: F.when(n > 0, F.array_repeat(F.lit(0).cast("long"), n)).otherwise(none)
    behind = lambda k: F.when(k > 0, F.get(entries, k - 1)["ix"]).otherwise(F.lit(-1))
    filled = F.flatten(F.transform(entries, lambda e, k: F.concat(gap(e["ix"] - behind(k) - 1), F.array(e["n"]))))
    return F.concat(filled, gap(size - F.size(filled)))


def probability(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / total), digit by digit in base 1000; count + 2 is at most total."""
    out, rest = F.lit(1).cast("long"), count + 2
    for power in (1_000_000, 1_000, 1):
        scaled = rest * 1000
        out, rest = out + whole(scaled, total) * power, scaled % total
    return out


def whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def contribution(p: Column, q: Column) -> Column:
    return whole((p - q) * (p - q), p + q)


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against every other one of its language, and the terms that it uses most beyond its language."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    texts = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    order = Window.partitionBy("lang").orderBy("source")
    numbered = texts.select(*GROUP).distinct().withColumn("ix", F.row_number().over(order) - 1)
    groups = written(numbered.withColumn("g", F.monotonically_increasing_id()), "groups")
    few = groups.limit(BROADCAST + 1).count() <= BROADCAST
    sent = F.broadcast if few else lambda df: df

    # A number stands for the group in the keys of counts, if groups are few; texts are never shuffled for it.
    entry = F.struct("ix", "n")
    keyed = texts.join(F.broadcast(groups), GROUP).select("g", "text") if few else texts
    key = ["g"] if few else GROUP
    counted = term_counts(keyed, key).join(sent(groups), key)
    gathered = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(entry)).alias("entries"))
    vectors = written(gathered.filter(F.col("docs") >= least).select("lang", "term", "total", "entries"), "vectors")

    # One row a language: its number of terms, and the totals of its sources in their order.
    used = vectors.select("lang", F.inline("entries")).groupBy("lang", "ix").agg(F.sum("n").alias("n"))
    kept = vectors.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("n_lang"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    sized = groups.join(used, ["lang", "ix"], "left").join(kept, "lang", "left").select("lang", "ix", "source", zero("n"), zero("terms"), zero("n_lang"))
    langs = sized.groupBy("lang", "terms", "n_lang").agg(F.sort_array(F.collect_list(F.struct("ix", "source", "n"))).alias("of"))
    totals = F.transform("of", lambda g: g["n"] + 2 * F.col("terms"))
    langs = written(langs.select("lang", "terms", (F.col("n_lang") + 2 * F.col("terms")).alias("total_lang"), F.transform("of", lambda g: g["source"]).alias("sources"), totals.alias("totals")), "languages")

    wide = vectors.join(sent(langs), "lang").withColumn("counts", dense(F.col("entries"), F.size("sources")))
    wide = wide.withColumn("p", F.zip_with("counts", "totals", probability))

    # Contributions of pairs of which one source at least has the term: the first of two that have it emits, else the only one.
    one = wide.select("lang", "counts", "p", F.posexplode_outer("counts").alias("i", "n")).filter("n > 0")
    own = F.get("p", F.col("i"))

    def emitted(q: Column, j: Column) -> Column:
        return F.when((j > F.col("i")) | ((j < F.col("i")) & (F.get("counts", j) == 0)), contribution(own, q))

    found = one.select("lang", "i", F.posexplode_outer(F.transform("p", emitted)).alias("j", "f")).filter("f IS NOT NULL")
    sums = found.groupBy("lang", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(F.sum("f").alias("sum"), F.count("*").alias("met"))

    every = groups.join(sent(langs), "lang").select("lang", "source", "ix", "terms", "totals", F.posexplode("sources").alias("j", "item")).filter("ix <> j")
    every = every.withColumns({"lo": F.least("ix", "j"), "hi": F.greatest("ix", "j")}).join(sums, ["lang", "lo", "hi"], "left")
    absent = lambda k: probability(F.lit(0).cast("long"), F.get("totals", F.col(k)))
    value = F.coalesce("sum", F.lit(0)) + (F.col("terms") - F.coalesce("met", F.lit(0))) * contribution(absent("lo"), absent("hi"))
    pairs = every.select(*GROUP, F.lit("pair").alias("part"), "item", F.when(F.col("terms") > 0, value).otherwise(0).cast("long").alias("value"))

    # Terms: only what a group has, against its language as a whole.
    of_lang = probability(F.col("total"), F.col("total_lang"))
    held = wide.withColumn("q", of_lang).select("lang", "term", "q", F.explode_outer(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"), F.col("p").alias("p"))).alias("g")).filter("g.n > 0 AND g.p > q")
    terms = held.select("lang", F.col("g.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), contribution(F.col("g.p"), F.col("q")).alias("value"))

    best = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best))
    # The limit of ranks reaches the tasks before the shuffle, so a group's terms never meet in one.
    return ranked(pairs).union(ranked(terms).filter(F.col("rank") <= top))


ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
    g AS (SELECT DISTINCT lang, source FROM d),
    v AS (SELECT lang, count(*) AS terms, sum(total) AS n FROM kept GROUP BY lang),
    n AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
    c AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0)::HUGEINT AS n, kept.total FROM g JOIN kept USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
    s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS of_group FROM c),
    p AS (SELECT s.lang, s.source, term, s.n AS held, 1 + (1000000000 * (s.n + 2))::HUGEINT // (of_group + 2 * terms)::HUGEINT AS p, 1 + (1000000000 * (total + 2))::HUGEINT // (v.n + 2 * terms)::HUGEINT AS q FROM s JOIN v USING (lang)),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE held > 0 AND p > q),
    ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM terms))
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10"""
