"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
NAMES = [
    "p1_found", "canonical_urls", "plain_texts", "clean_texts", "rebuilt_documents", "vector_topk_batch", "vector_topk_blocks", "hybrid_search",
    "retrieval_evaluation", "current_revisions", "lineage_counters", "run_report", "topic_merge", "curated_topics", "catalog_topics", "topic_violations", "markdown_sections", "crawl_plan",
]


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value.replace(tzinfo=None) if getattr(value, "tzinfo", None) else value


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, name):
    db = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, small)
    got = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(map(plain, row)) for row in got.fetchall())
    assert Counter(tuple(plain(row[c]) for c in columns) for row in df.collect()) == want


@pytest.mark.parametrize("name", ["p1_all_descendants", "p1_all_ancestors"])
def test_pairs_of_all_topics_equal_sql(spark, small, name):
    test_query_equals_sql(spark, small, name)
    asked = {r.topic_id for r in entry.queries()[name](spark, small).collect()}
    assert any(t % 20 for t in asked)


def test_crawl_plan_keeps_all_links(spark, tmp_path):
    html = "".join(f'<a href="/p{i}">Page {i}</a>' for i in range(120))
    rows = [(1, "https://a.example/", html, 200, 1)]
    spark.createDataFrame(rows, "raw_id long, url string, html string, status_code int, fetched_at int").write.parquet(f"{tmp_path}/raw_documents.parquet")
    got = entry.queries()["crawl_plan"](spark, str(tmp_path)).collect()
    assert sorted((r.position, r.url) for r in got) == [(i, f"https://a.example/p{i}") for i in range(120)]


def test_entry_runs(spark, small):
    assert entry.entry(spark).columns == ["embedding_version_id", "query_id", "chunk_id", "score", "position"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
