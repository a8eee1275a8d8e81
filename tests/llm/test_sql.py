"""Columns of the contracts that SQL can express, of queries that it can't express as a whole, over the whole sf0.01 table."""

from pathlib import Path

import duckdb
import pytest

from veridane.llm import queries

DATA = "/root/testdata/sf0.01"

DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN (length({DIGITS}) - i) % 2 = 1 THEN 2 * {DIGITS}[i]::INT // 10 + 2 * {DIGITS}[i]::INT % 10 ELSE {DIGITS}[i]::INT END)) % 10 = 0"
CONTRACTS = {
    "op2_token_counts": "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents",
    "op3_merkle_fingerprints": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(doc_id) OVER w, max(doc_id) OVER ()) AS after FROM documents WINDOW w AS (ORDER BY doc_id DESC)),
        p AS (SELECT d.*, length(d.t) // 3 AS k, n.t AS u FROM d JOIN d n ON n.doc_id = d.after)
        SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(left(t, length(t) - k) || left(u, k)) AS edited_sha256 FROM p""",
    "op7_personal_data": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
          len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: list_bool_and(list_transform(string_split(m, '.'), lambda x: x::HUGEINT <= 255))))::BIGINT AS n_ip,
          len(list_filter(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda m: length({DIGITS}) BETWEEN 14 AND 19 AND {LUHN}))::BIGINT AS n_card,
          len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: length({DIGITS}) BETWEEN 10 AND 15))::BIGINT AS n_phone FROM d""",
    "op8_language_id": """SELECT doc_id, coalesce(regexp_matches(text, '\\pL'), false) AS letters FROM documents""",
    "op10_license_scan": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p AS (SELECT doc_id, len(w) AS n, list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] = 'mit' AND w[i + 1] = 'license' THEN {'i': i - 1, 'l': 'mit'} WHEN w[i] = 'apache' AND w[i + 1] = 'license' THEN {'i': i - 1, 'l': 'apache'}
            WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN {'i': i - 1, 'l': 'gpl'} END), lambda x: x IS NOT NULL) AS f FROM d)
        SELECT doc_id, n::BIGINT AS n_words, len(f)::BIGINT AS n_base, list_min(list_transform(f, lambda x: x.i))::BIGINT AS first_word, list_max(list_transform(f, lambda x: x.i))::BIGINT AS last_word,
          array_to_string(list_sort(list_distinct(list_transform(f, lambda x: x.l))), ',') AS base_labels FROM p""",
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract_columns_equal_sql(spark, name):
    duck = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    want = duck.execute(CONTRACTS[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, DATA)
    if name == "op8_language_id":
        got = got.selectExpr("doc_id", "lang_pred <> 'und' AS letters")
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(repr, want.fetchall()))
