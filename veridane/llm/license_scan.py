"""License scans by diagonal voting, with DataFrame functions only.

Words of a text become rolling three-word grams; their hashes are joined to the
positions of all grams of the license templates, and the words themselves are
compared in the join. A match of text word i and template word j votes for
diagonal i - j. Votes are summed by diagonal; diagonals at most ``SHIFT`` apart
are merged, which bridges inserted or missing words, but no further than half
the template's length from the diagonal with most votes, so chains of stray
votes don't grow into spans. A merged span is verified by the share of the
template's words that it covers.

Templates are a table (label, notice), by default the public texts of
`license_texts`, whole licenses and notices of them; a whole license and its
notice are templates of their own. Their grams are counted: up to ``BROADCAST`` rows go to every
task, beyond that the join is a shuffle by hash.

One scan: each document's grams are made, joined and filtered in one stage; what
is shuffled are the matches and one row a document. The row's number is made
and used within that stage, so a task that is run again makes the same numbers.

The base rule's phrases are found among the same grams. A phrase alone scores
``NAMED``, under any verified span; a span scores the share that it covers.

Edge cases: a null text has no words; labels are an empty string where there are
none, places null; non-ASCII letters are word characters, and lower-casing
beyond A-Z changes no base result; rows that repeat are scanned each, also with
null ids; texts of any length are scanned whole; of diagonals with equal votes the
greatest is the span's middle; an empty table of documents gives an empty result,
one of templates base labels alone; templates of under three words are never
found; other columns of documents, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridane.llm.license_texts import TEMPLATES

SHIFT, LEAST = 3, 0.7
#: The score of a text that names a license by a base phrase, and holds no template.
NAMED = 0.5
#: Rows of template grams that are broadcast, of some 100 bytes.
BROADCAST = 1 << 18
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def zipped(w: Column) -> Column:
    """The grams of words w as structs a, b, c; the last two lack words."""
    return F.arrays_zip(w.alias("a"), F.slice(w, 2, F.size(w)).alias("b"), F.slice(w, 3, F.size(w)).alias("c"))


def once(value: Column, use) -> Column:
    """use(value), with value evaluated once however often use names it."""
    return F.transform(F.array(value), use)[0]


def public_templates(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(label).alias("label"), F.lit(notice).alias("notice")) for label, notice in TEMPLATES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def template_grams(templates: DataFrame) -> DataFrame:
    """(hash, template, label, size, j, ta, tb, tc): a row for each gram of each template."""
    source = templates.select(F.xxhash64("label", "notice").alias("template"), "label", words(F.col("notice")).alias("w")).distinct().withColumn("size", F.size("w"))
    grams = source.select("template", "label", "size", F.posexplode(zipped(F.col("w"))).alias("j", "g")).filter(F.col("g.c").isNotNull())
    return grams.select(F.xxhash64("g.a", "g.b", "g.c").alias("hash"), "template", "label", "size", "j", F.col("g.a").alias("ta"), F.col("g.b").alias("tb"), F.col("g.c").alias("tc"))


def phrase(g: Column, i: Column) -> Column:
    """A base phrase that starts at gram g, word i, as (at, label); else null."""
    a, b, c = g["a"], g["b"], g["c"]
    label = F.when((a == "mit") & (b == "license"), "mit").when((a == "apache") & (b == "license"), "apache").when((a == "general") & (b == "public") & (c == "license"), "gpl")
    return F.when(label.isNotNull(), F.named_struct(F.lit("at"), i.cast("long"), F.lit("label"), label))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, templates: DataFrame | None = None) -> DataFrame:
    """A row for each document: words, base places and labels, all labels, and a score: the best verified span's share of its template, else NAMED where there is a base phrase."""
    grams = once(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.array_contains(w, "license").alias("licensed"), zipped(w).alias("grams")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("row", "id", grams.alias("s"))
    places = F.when(F.col("s.licensed"), F.filter(F.transform(F.col("s.grams"), phrase), lambda p: p.isNotNull()))
    based = rows.select("row", "id", F.col("s.n_words").alias("n_words"), places.alias("places"), F.col("s.grams").alias("grams"))
    exploded = based.select("row", "id", "n_words", "places", F.posexplode_outer("grams").alias("i", "g"))
    t = template_grams(public_templates(docs.sparkSession) if templates is None else templates)
    if t.limit(BROADCAST + 1).count() <= BROADCAST:
        t = F.broadcast(t)
    same = (F.xxhash64("g.a", "g.b", "g.c") == F.col("hash")) & (F.col("g.a") == F.col("ta")) & (F.col("g.b") == F.col("tb")) & (F.col("g.c") == F.col("tc"))
    # A document's first gram, matched or not, carries its base result; all other rows are matches.
    head = F.coalesce(F.col("i") == 0, F.lit(True))
    votes = exploded.join(t, same, "left").filter(head | F.col("template").isNotNull())
    votes = votes.select("row", F.when(head, F.struct("id", "n_words", "places")).alias("doc"), "template", "label", "size", F.col("i").alias("at"), "j", (F.col("i") - F.col("j")).alias("diagonal")).repartition("row")
    lines = votes.groupBy("row", "template", "label", "size", "diagonal").agg(F.max("doc").alias("doc"), F.min("at").alias("start"), F.collect_set("j").alias("hits"))
    # Neighbouring diagonals make one span, about the one with most votes.
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > SHIFT).cast("int"), F.lit(0))
    chains = lines.withColumn("apart", apart).withColumn("chain", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    middle = F.max(F.struct(F.size("hits").alias("votes"), "diagonal")).over(Window.partitionBy("row", "template", "chain"))["diagonal"]
    width = F.greatest(F.col("size"), F.lit(2 * SHIFT))
    chains = chains.withColumn("part", F.floor((F.col("diagonal") - middle + F.floor(width / 2)) / width))
    spans = chains.groupBy("row", "template", "label", "size", "chain", "part").agg(F.max("doc").alias("doc"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda j: F.array(j, j + 1, j + 2)))))
    share = F.when(F.col("template").isNotNull(), covered / F.col("size"))
    found = spans.select("row", "doc", "label", share.alias("share"))
    good = F.col("share") >= least
    each = found.groupBy("row").agg(F.max("doc").alias("doc"), F.collect_set(F.when(good, F.col("label"))).alias("labels"), F.max(F.when(good, F.col("share"))).alias("share"))
    base = F.array_distinct(F.transform(F.coalesce(F.col("doc.places"), F.array().cast("array<struct<at:bigint,label:string>>")), lambda p: p["label"]))
    at = F.transform(F.coalesce(F.col("doc.places"), F.array().cast("array<struct<at:bigint,label:string>>")), lambda p: p["at"])
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    return each.select(
        F.col("doc.id").alias(id_col),
        F.col("doc.n_words").alias("n_words"),
        F.size(at).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.array_union(base, "labels")).alias("labels"),
        F.greatest(F.when(F.size(at) > 0, F.lit(NAMED)), F.col("share"), F.lit(0.0)).alias("score"),
    )
