"""DuckDB SQL of op5: repeats of at least n words cover the same words as repeated n-word windows, and a repeat of over m words is a repeated window of m + 1."""

from veridane.llm.repetition import MAX_COVERED, MAX_LONGEST, MIN_REPEAT


def covered(n: int, name: str) -> str:
    """CTEs: words inside n-word windows that occur twice in their text."""
    return f"""{name}_w AS (SELECT rid, i, CASE WHEN count(*) OVER win = {n} THEN string_agg(word, ' ') OVER win END AS part FROM words
      WINDOW win AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)),
    {name}_r AS (SELECT rid, i, part IS NOT NULL AND count(*) OVER (PARTITION BY rid, part) > 1 AS again FROM {name}_w),
    {name}_c AS (SELECT rid, i, bool_or(again) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM {name}_r),
    {name} AS (SELECT rid, count(*) FILTER (inside) AS n FROM {name}_c GROUP BY rid)"""


ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    words AS (SELECT rid, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d)),
    lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
    sizes AS (SELECT rid, count(*) AS n, sum(length(word)) AS chars FROM words GROUP BY rid),
    {covered(3, "three")}, {covered(MIN_REPEAT, "five")}, {covered(MAX_LONGEST + 1, "long")},
    counts AS (SELECT doc_id, coalesce(s.n, 0) AS n_words, coalesce(s.chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      coalesce(l.n, 0) AS n_dup_lines, coalesce(t.n, 0) AS n_repeat_words, coalesce(c.n, 0) AS n_covered, coalesce(g.n, 0) AS n_long
      FROM d LEFT JOIN sizes s USING (rid) LEFT JOIN lines l USING (rid) LEFT JOIN three t USING (rid) LEFT JOIN five c USING (rid) LEFT JOIN long g USING (rid))
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, n_covered::BIGINT AS n_covered,
      n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_covered <= {MAX_COVERED} * n_words AND n_long = 0 AS kept FROM counts"""
