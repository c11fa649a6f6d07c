"""Registered queries against DuckDB over the driver's smallest tables, where those exist."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidemark.plans import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
CHECKED = ("top_categories", "top_categories_nested", "category_trend", "category_delta_reference_mode", "article_delta", "category_depth_stats",
           "search_categories_trend", "category_trend_or_search", "extract_article_category", "categories_trend_top_articles", "read_pageview_dump", "dataset_stats",
           "backfill_range", "scan_daily_views", "write_dimension", "scan_vectors_source", "parse_replica_tsv", "wiki_editions", "site_matrix_editions",
           "column_functions", "sub_categories_counted", "category_trend_with_top", "embed_categories", "encode_texts", "upsert_vectors", "most_similar",
           "similarity_matrix", "category_delta", "stream_daily_views", "category_components", "taken_days", "category_delta_by_months",
           "global_views_by_months", "depth_histogram", "category_rollup_totals")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for name in ("supplier", "part", "lineitem", "embeddings", "nation", "customer"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return c


def plain(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, sql, name):
    found = catalog.queries()[name](spark, DIR)
    expected = sql.execute(catalog.oracle_sql()[name])
    assert plain(found.columns, found.collect()) == plain([d[0] for d in expected.description], expected.fetchall())


def test_all_queries_have_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
