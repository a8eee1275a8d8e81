"""Queries of cleaning and validation, over question records made from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridane.functions import text as T
from veridane.operators import clean, validate
from veridane.plans.registry import register, table
from veridane.sources import files, scratch

IDS = (*clean.MANUAL_IDS, *clean.AUTO_IDS, *clean.COSMETIC_IDS, *clean.FALSE_POSITIVE_IDS, *clean.INCONSISTENT_IDS)
ENTRIES = "array<struct<key:string,value:string>>"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, original_question, statements) of each document: its whole text in thirds, in four layouts by id, all of which hold all three; statements, of all three, null, out of order, or with a spaced label."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("t"))
    third = F.expr("length(t) div 3").cast("int")
    a, b, c = F.substring("t", F.lit(1), third), F.substring("t", third + 1, third), F.substring("t", 2 * third + 1, F.length("t"))
    n = F.col("doc_id")
    source = (
        F.when(n % 4 == 0, F.concat(F.lit("Intro <statements> (a) . "), a, F.lit(" (b) "), b, F.lit(" (c) "), c, F.lit(" <choices> ① x")))
        .when(n % 4 == 1, F.concat(F.lit("Intro <choices> ① "), a, F.lit(" ② "), b, F.lit(" ③ "), c))
        .when(n % 4 == 2, F.concat(F.lit("(a) "), a, F.lit(" (b) "), b, F.lit(" (c) "), c, F.lit(" <question> which")))
        .otherwise(F.concat(F.lit("plain "), F.col("t")))
    )
    entry = lambda key, value: F.named_struct(F.lit("key"), F.lit(key), F.lit("value"), value)
    held = (
        F.when(n % 5 == 0, F.lit(None).cast(ENTRIES))
        .when(n % 5 == 1, F.array(entry("statement_2", b), entry("statement_1", a), entry("statement_3", c)))
        .otherwise(F.array(entry("statement_1", F.concat(F.lit("(a) . "), a)), entry("statement_2", F.concat(F.lit("(b) . "), b)), entry("statement_3", F.concat(F.lit("(c) . "), c))))
    )
    name = F.when(n < len(IDS), F.get(F.array(*[F.lit(x) for x in IDS]), n.cast("int"))).otherwise(F.concat(F.lit("q"), n.cast("string")))
    return d.select(name.alias("id"), source.alias("original_question"), held.alias("statements"))


def quoted(*xs: str) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


WS = r"[\s\x0B]"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_statement(x: str) -> str:
    return f"regexp_replace({sql_trim(x)}, '^\\(([a-z])\\){WS}+\\.', '(\\1).')"


def sql_comparable(x: str) -> str:
    labels = f"regexp_replace({x}, '\\(([a-z])\\){WS}+\\.', '(\\1).', 'g')"
    return sql_trim(f"regexp_replace({labels}, '{WS}+', ' ', 'g')")


QUESTIONS = f"""WITH d AS (SELECT doc_id AS n, replace(text, chr(10), ' ') AS t, length(text) // 3 AS k FROM documents),
    s AS (SELECT n, t, substring(t, 1, k) AS a, substring(t, k + 1, k) AS b, substring(t, 2 * k + 1) AS c FROM d),
    q AS (SELECT CASE WHEN n < {len(IDS)} THEN [{quoted(*IDS)}][n + 1] ELSE 'q' || n END AS id,
      CASE n % 4 WHEN 0 THEN 'Intro <statements> (a) . ' || a || ' (b) ' || b || ' (c) ' || c || ' <choices> ① x' WHEN 1 THEN 'Intro <choices> ① ' || a || ' ② ' || b || ' ③ ' || c
        WHEN 2 THEN '(a) ' || a || ' (b) ' || b || ' (c) ' || c || ' <question> which' ELSE 'plain ' || t END AS original_question,
      CASE n % 5 WHEN 0 THEN NULL WHEN 1 THEN [{{'key': 'statement_2', 'value': b}}, {{'key': 'statement_1', 'value': a}}, {{'key': 'statement_3', 'value': c}}]
        ELSE [{{'key': 'statement_1', 'value': '(a) . ' || a}}, {{'key': 'statement_2', 'value': '(b) . ' || b}}, {{'key': 'statement_3', 'value': '(c) . ' || c}}] END AS statements FROM s),
    z AS (SELECT *, CASE WHEN original_question LIKE 'Intro <st%' THEN regexp_extract(original_question, '<statements>(.*)<choices>', 1, 's') WHEN original_question LIKE 'Intro%' THEN regexp_extract(original_question, '<choices>(.*)', 1, 's')
        WHEN original_question LIKE '(a)%' THEN regexp_extract(original_question, '^(.*) <question>', 1, 's') END AS span FROM q),
    g AS (SELECT *, CASE WHEN span LIKE '%①%' THEN ['① ' || split_part(split_part(span, '① ', 2), ' ② ', 1), '② ' || split_part(split_part(span, ' ② ', 2), ' ③ ', 1), '③ ' || split_part(span, ' ③ ', 2)]
        WHEN span IS NOT NULL THEN list_filter([regexp_extract(span, '(\\(a\\).*?)( \\(b\\)|$)', 1, 's'), regexp_extract(span, '(\\(b\\).*?)( \\(c\\)|$)', 1, 's'), regexp_extract(span, '(\\(c\\).*)', 1, 's')], lambda x: x <> '') END AS raw FROM z),
    seg AS (SELECT *, list_transform(raw, lambda x: {sql_statement("x")}) AS pieces FROM g)"""


@register("label_normalise", f"SELECT doc_id, md5({sql_statement("'(a) . ' || text")}) AS digest FROM documents")
def label_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.statement_text(F.concat(F.lit("(a) . "), F.col("text")))).alias("digest"))


@register("norm_compare_hash", f"SELECT doc_id, md5({sql_comparable("'x (b)  .  ' || text || ' (a) . '")}) AS digest FROM documents")
def norm_compare_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.comparable(F.concat(F.lit("x (b)  .  "), F.col("text"), F.lit(" (a) . ")))).alias("digest"))


@register("span_between", f"SELECT page_id, nullif({sql_trim("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")}, '') AS title FROM pages")
def span_between(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", clean.span_between(F.col("html"), "<title>", "</title>").alias("title"))


@register("label_scheme", f"{QUESTIONS} SELECT id, CASE WHEN original_question LIKE 'Intro <st%' OR original_question LIKE '(a)%' THEN 'letters' WHEN original_question LIKE 'Intro%' THEN 'circled' END AS scheme FROM q")
def label_scheme(spark, sf_dir):
    return questions(spark, sf_dir).select("id", clean.label_scheme(F.col("original_question")).alias("scheme"))


@register("sequential_split", f"{QUESTIONS}, e AS (SELECT id, generate_subscripts(pieces, 1) AS k, unnest(pieces) AS text FROM seg) SELECT id, 'statement_' || k AS key, text FROM e")
def sequential_split(spark, sf_dir):
    return questions(spark, sf_dir).select("id", F.inline(clean.resegment(F.col("original_question")))).withColumnRenamed("value", "text")


@register("resegment", f"{QUESTIONS} SELECT id, coalesce(len(pieces), 0)::BIGINT AS n, array_to_string(pieces, '|') AS statements FROM seg")
def resegment(spark, sf_dir):
    q = questions(spark, sf_dir).select("id", clean.resegment(F.col("original_question")).alias("e"))
    return q.select("id", clean.n_statements(F.col("e")).alias("n"), F.array_join(F.transform("e", lambda x: x["value"]), "|").alias("statements"))


@register("statement_units", f"{QUESTIONS} SELECT id, generate_subscripts(statements, 1)::BIGINT - 1 AS pos, unnest(statements).key AS key, unnest(statements).value AS text FROM q")
def statement_units(spark, sf_dir):
    u = questions(spark, sf_dir).select("id", F.posexplode("statements").alias("pos", "e"))
    return u.select("id", F.col("pos").cast("long").alias("pos"), "e.key", F.col("e.value").alias("text"))


@register("statement_histogram", f"{QUESTIONS} SELECT coalesce(len(statements), 0)::BIGINT AS statements, count(*) AS n FROM q GROUP BY 1")
def statement_histogram(spark, sf_dir):
    return questions(spark, sf_dir).groupBy(clean.n_statements(F.col("statements")).alias("statements")).agg(F.count("*").alias("n"))


def sql_leak(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {quoted(p)})" for p in T.INSTRUCTION_PHRASES) + ")"


def sql_final(x: str) -> str:
    return "(" + " OR ".join(f"ends_with({sql_trim(x)}, {quoted(m)})" for m in T.FINAL_MARKS) + ")"


@register("short_text", f"SELECT doc_id, length({sql_trim('text')}) < 10 AS short FROM documents")
def short_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.too_short(F.col("text")).alias("short"))


@register("leak_flags", f"SELECT conv_id, turn, {sql_leak("CASE WHEN turn % 3 = 0 THEN text || ' Which Of The Following' WHEN turn % 3 = 1 THEN text || ' choose' ELSE text END")} AS leak FROM conversations")
def leak_flags(spark, sf_dir):
    said = F.concat(F.col("text"), F.when(F.col("turn") % 3 == 0, " Which Of The Following").when(F.col("turn") % 3 == 1, " choose").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.leaks_instruction(said).alias("leak"))


@register("final_punct", f"SELECT doc_id, {sql_final('text')} AS finished FROM documents")
def final_punct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.ends_finished(F.col("text")).alias("finished"))


@register("source_containment", f"{QUESTIONS}, u AS (SELECT id, original_question, unnest(statements) AS e FROM q) SELECT id, e.key AS key, contains({sql_comparable('original_question')}, {sql_comparable('e.value')}) AS found FROM u")
def source_containment(spark, sf_dir):
    u = questions(spark, sf_dir).select("id", "original_question", F.explode("statements").alias("e"))
    return u.select("id", "e.key", F.contains(T.comparable(F.col("original_question")), T.comparable(F.col("e.value"))).alias("found"))


@register("sequential_keys", f"{QUESTIONS} SELECT id, list_transform(statements, lambda x: x.key) = list_transform(range(1, len(statements) + 1), lambda i: 'statement_' || i) AS ok FROM q WHERE statements IS NOT NULL")
def sequential_keys(spark, sf_dir):
    return questions(spark, sf_dir).filter("statements IS NOT NULL").select("id", validate.keys_in_order(F.col("statements")).alias("ok"))


EXEMPT_SOURCE = quoted(*clean.MANUAL_IDS, *clean.FALSE_POSITIVE_IDS)
EXEMPT_GATE = quoted(*clean.MANUAL_IDS, *clean.FALSE_POSITIVE_IDS, *clean.COSMETIC_IDS)
PROBLEMS = f"""{QUESTIONS}, u AS (SELECT id, original_question, unnest(statements) AS e FROM q),
    p AS (SELECT id, 'missing' AS "check", NULL AS key, 'missing statements' AS message FROM q WHERE statements IS NULL
    UNION ALL SELECT id, 'keys', NULL, 'non-sequential keys: ' || array_to_string(list_transform(statements, lambda x: x.key), ', ') FROM q WHERE statements[1].key <> 'statement_1'
    UNION ALL SELECT id, 'short', e.key, e.key || ' suspiciously short: ' || e.value FROM u WHERE length({sql_trim('e.value')}) < 10
    UNION ALL SELECT id, 'leak', e.key, e.key || ' possible instruction leak: ' || e.value[1:160] FROM u WHERE {sql_leak('e.value')}
    UNION ALL SELECT id, 'punctuation', e.key, e.key || ' may be missing final punctuation: ' || right(e.value, 80) FROM u WHERE NOT {sql_final('e.value')}
    UNION ALL SELECT id, 'source', e.key, e.key || ' not found verbatim in original_question' FROM u WHERE id NOT IN ({EXEMPT_SOURCE}) AND NOT contains({sql_comparable('original_question')}, {sql_comparable('e.value')}))"""


@register("validation_problems", f'{PROBLEMS} SELECT id, "check", key, message FROM p')
def validation_problems(spark, sf_dir):
    return validate.problems(questions(spark, sf_dir)).drop("nth")


@register(
    "validation_gate",
    f"""{PROBLEMS}, a AS (SELECT count(*) AS records, sum(coalesce(len(statements), 0))::BIGINT AS statements FROM q), b AS (SELECT count(*) AS problems, count(*) FILTER (id NOT IN ({EXEMPT_GATE})) AS unexpected FROM p)
    SELECT records, statements, problems, unexpected, CASE WHEN records <> 93 THEN 'record count' WHEN statements <> 301 THEN 'statement count' WHEN unexpected > 0 THEN 'unexpected problems' ELSE 'Validation passed.' END AS verdict FROM a, b""",
)
def validation_gate(spark, sf_dir):
    return validate.gate(questions(spark, sf_dir))


MODE = f"CASE WHEN id IN ({quoted(*clean.MANUAL_IDS)}) THEN 'manual' WHEN id IN ({quoted(*clean.AUTO_IDS)}) THEN 'auto' WHEN id IN ({quoted(*clean.COSMETIC_IDS)}) THEN 'cosmetic' END"
CLEANED = f"""{QUESTIONS}, m AS (SELECT *, {MODE} AS mode, list_transform(statements, lambda x: x.value) AS held, list_transform(statements, lambda x: {sql_statement('x.value')}) AS fixed FROM seg),
    c AS (SELECT id, mode, held, CASE WHEN mode = 'manual' THEN [{quoted(*clean.MANUAL_PATCH.values())}] WHEN mode = 'auto' THEN coalesce(pieces, held) WHEN mode = 'cosmetic' THEN fixed ELSE held END AS made,
      CASE WHEN mode = 'manual' THEN true WHEN mode = 'auto' THEN pieces IS NOT NULL WHEN mode = 'cosmetic' THEN fixed IS DISTINCT FROM held ELSE false END AS logged,
      CASE WHEN mode = 'auto' AND pieces IS NULL THEN 'no statements found' END AS warning FROM m)"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean(questions(spark, sf_dir))


@register("clean_route", f"{CLEANED} SELECT id, mode, array_to_string(made, '|') AS statements, logged, warning FROM c")
def clean_route(spark, sf_dir):
    return cleaned(spark, sf_dir).select("id", "mode", F.array_join(F.transform("new_statements", lambda e: e["value"]), "|").alias("statements"), "logged", "warning")


@register("change_log", f"{CLEANED} SELECT id, coalesce(len(held), 0)::BIGINT AS old_count, coalesce(len(made), 0)::BIGINT AS new_count, mode FROM c WHERE logged")
def change_log(spark, sf_dir):
    return clean.change_log(cleaned(spark, sf_dir))


@register("cleaning_totals", f"{CLEANED}, t AS (SELECT count(*) AS records, sum(coalesce(len(held), 0))::BIGINT AS before, sum(coalesce(len(made), 0))::BIGINT AS after FROM c) SELECT *, CASE WHEN after <> 315 THEN 'expected 315 statements' END AS warning FROM t")
def cleaning_totals(spark, sf_dir):
    return clean.totals(cleaned(spark, sf_dir))


@register("drop_inconsistent", f"{QUESTIONS} SELECT id FROM q WHERE id NOT IN ({quoted(*clean.INCONSISTENT_IDS)})")
def drop_inconsistent(spark, sf_dir):
    return clean.drop_inconsistent(questions(spark, sf_dir)).select("id")


@register("choice_markers", "SELECT doc_id, md5('① ' || text || chr(10) || '② ' || lang) AS digest FROM documents")
def choice_markers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("1. "), F.col("text"), F.lit("\n2. "), F.col("lang")).alias("t"))
    return d.select("doc_id", F.md5(clean.circled_choices(F.col("t"))).alias("digest"))


# --- files ----------------------------------------------------------------

FILED = f"{QUESTIONS} SELECT id, coalesce(len(statements), 0)::BIGINT AS n, array_to_string(list_transform(statements, lambda x: x.key), ',') AS keys, md5(array_to_string(list_transform(statements, lambda x: x.value), '|')) AS digest, md5(original_question) AS question FROM q"


def filed(spark: SparkSession, q: DataFrame, one_array: bool) -> DataFrame:
    """q written to a file and read again."""
    path = scratch.fresh(spark, "questions")
    files.write_questions(q, path, one_array)
    back = files.read_questions(spark, path, lines=not one_array)
    text = F.array_join(F.transform("statements", lambda e: e["value"]), "|")
    return back.select("id", clean.n_statements(F.col("statements")).alias("n"), F.array_join(F.transform("statements", lambda e: e["key"]), ",").alias("keys"), F.md5(text).alias("digest"), F.md5("original_question").alias("question"))


@register("question_lines_file", FILED)
def question_lines_file(spark, sf_dir):
    """All records through a file of JSON lines, statements in their order."""
    return filed(spark, questions(spark, sf_dir), False)


@register("question_array_file", FILED.replace("FROM q", f"FROM q WHERE id IN ({quoted(*IDS)})"))
def question_array_file(spark, sf_dir):
    """The named records of the shipped set, a small one, through one indented JSON array."""
    return filed(spark, questions(spark, sf_dir).filter(F.col("id").isin(*IDS)), True)


@register("cleaned_set_file", f"{CLEANED} SELECT id, array_to_string(made, '|') AS statements FROM c")
def cleaned_set_file(spark, sf_dir):
    """The cleaned set as a later step reads it."""
    path = scratch.fresh(spark, "cleaned")
    files.write_questions(cleaned(spark, sf_dir).select("id", "original_question", F.col("new_statements").alias("statements")), path)
    return files.read_questions(spark, path, lines=True).select("id", F.array_join(F.transform("statements", lambda e: e["value"]), "|").alias("statements"))
