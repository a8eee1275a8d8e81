"""The pipeline against plain stages, and the registered queries against their SQL."""

import collections
import pathlib
from pathlib import Path

import brute
import duckdb
import pyarrow.parquet as pq
import pytest
from test_tokens import byte_ids, check_packed

import corpus_pipeline
from veridane.llm import queries
from veridane.sources.scratch import shared_dir

BASE = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_stages(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{BASE}/documents.parquet").to_pylist()]
    good = [r for r in rows if brute.quality(r[1])[-1] and any(c.isalpha() for c in r[1])]
    single = {i for i, _, c in brute.component_ids(good) if i == c}
    left = [(i, t) for i, t in good if i in single]
    expected = collections.defaultdict(list)
    for (i, t), spans in zip(left, brute.all_spans([t for _, t in left]), strict=True):
        expected[i].append([*byte_ids(brute.redacted(t, spans)), 0])
    check_packed(corpus_pipeline.run(spark, BASE).collect(), expected)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, BASE).columns == docs.columns


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, BASE).count() == 0


def test_pipeline_of_odd_rows(spark, docs, rows, tmp_path):
    """Nulls in any column, repeated rows and ids, empty and very long texts: what is left is packed whole, and only good documents are left."""
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = {i for i, t in [*[(r[0], r[1]) for r in rows], (None, "a null id"), (None, rows[3][1])] if t and len(t) < 20000 and brute.quality(t)[-1]}
    assert pieces and {p["doc_id"] for p in pieces} <= good
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append((p["start"], p["length"], p["doc_tokens"]))
    for parts in by_sequence.values():
        ends = [0, *[a + n for a, n in sorted(parts)]]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024
    for parts in by_doc.values():  # one document of each group of copies, so an id occurs once
        ends = [0, *[a + n for a, n, _ in sorted(parts)]]
        assert [a for a, *_ in sorted(parts)] == ends[:-1] and {total for *_, total in parts} == {ends[-1]}


def test_tables_of_a_run_are_cleared(spark, tmp_path):
    """All but what the last stage reads."""
    spark.read.parquet(f"{BASE}/documents.parquet").limit(30).write.parquet(str(tmp_path / "documents.parquet"))
    folder = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    corpus_pipeline.run(spark, str(tmp_path)).count()
    assert len(set(folder.iterdir()) - before) == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for f in Path(BASE).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    got = queries.QUERIES[name](spark, BASE)
    want = duck.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())
