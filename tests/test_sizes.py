"""What larger tables than the driver's smallest ones bring about, on small inputs."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_queries import DIR, plain
from tidemark.functions import columns
from tidemark.operators import graph, ingest
from tidemark.operators import vectors as search
from tidemark.plans import catalog
from tidemark.sources import dumps

tables_given = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """The smallest tables with article numbers so high that article and category pages have the same page_id, as from a million parts on."""
    folder, c = str(tmp_path_factory.mktemp("far")), duckdb.connect()
    high = {"part": "* REPLACE (p_partkey + 1000000 AS p_partkey)", "lineitem": "* REPLACE (l_partkey + 1000000 AS l_partkey)", "supplier": "*", "nation": "*"}
    for name, columns in high.items():
        c.execute(f"COPY (SELECT {columns} FROM '{DIR}/{name}.parquet') TO '{folder}/{name}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return folder, c


@tables_given
@pytest.mark.parametrize("name", ["extract_articles", "extract_categories", "extract_category_graph", "extract_article_category"])
def test_pages_of_articles_and_categories_are_not_taken_for_each_other(spark, far, name):
    folder, c = far
    found, expected = catalog.queries()[name](spark, folder), c.execute(catalog.oracle_sql()[name])
    assert plain(found.columns, found.collect()) == plain([d[0] for d in expected.description], expected.fetchall())


def test_pairs_are_scored_in_pieces_that_give_what_the_whole_gives():
    rng = np.random.default_rng(3)
    vectors = [*rng.normal(size=(40, 3)).tolist(), None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0]]
    asked = [*vectors[30:], *vectors[:9]]
    units = search._by_size(pa.array(vectors, pa.list_(pa.float64())))
    ids, queries = pa.array([f"q{i}" for i in range(len(asked))]), search._by_size(pa.array(asked, pa.list_(pa.float64())))

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or None in [*a, *b] or not any(a) or not any(b):
            return None
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    expected = {(f"q{i}", j): cosine(a, b) for i, a in enumerate(asked) for j, b in enumerate(vectors)}
    parts = [search._part(ids, queries, pa.array(range(len(vectors))), units, k, min(4, len(asked) - k), None) for k in range(0, len(asked), 4)]
    assert max(p.num_rows for p in parts) == 4 * len(vectors)
    found = {(r["query_id"], r["qid"]): r["score"] for p in parts for r in p.to_pylist()}
    assert found.keys() == expected.keys()
    assert all((found[k] is None) == (v is None) and (v is None or abs(found[k] - v) < 1e-9) for k, v in expected.items())


def test_a_dump_line_is_split_once(spark):
    lines = spark.range(3).selectExpr("concat('en.wikipedia T ', id, ' desktop ', id, ' A1') as value")
    plan = dumps.parse_dump_lines(lines, F.lit("1998-01-01").cast("date"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted(map(tuple, plan.select("page_id", "daily_views").collect())) == [(0, 0), (1, 1), (2, 2)]


def test_numbers_of_dumps_are_those_of_32_bits(spark):
    texts = ["0", "4294967295", "4294967296", "00000000000000000007", "99999999999999999999", "000000000000000000007", "9223372036854775808", "-1", "+1", " 1", "", "1.0", None]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", columns.u32(F.col("t"))).collect()
    assert [r[1] for r in sorted(found)] == [0, 4294967295, None, 7] + [None] * 9


def test_roots_of_one_component_are_told_apart_in_many_tasks(spark):
    n = 200  # all in one component but for the last two: one that it leads to and one alone
    edges = spark.createDataFrame([(i, (2 * i + k) % n) for i in range(n) for k in (0, 1)] + [(5, n)], "parent_qid long, child_qid long")
    categories = spark.range(n + 2).withColumnRenamed("id", "qid")
    pairs = spark.createDataFrame([(1000 + i, i) for i in range(n + 2)], "article_qid long, category_qid long")
    found = graph.articles_in_category(categories.select(F.col("qid").alias("root")), categories, edges, pairs, None).withColumn("task", F.spark_partition_id()).collect()
    expected = {(r, 1000 + a) for r in range(n) for a in range(n + 1)} | {(n, 1000 + n), (n + 1, 1001 + n)}
    assert len(found) == len(expected) and {(r["root"], r["article_qid"]) for r in found} == expected
    tasks = [sum(r["task"] == t for r in found) for t in {r["task"] for r in found}]
    assert len(tasks) > 2 and max(tasks) < 0.7 * len(found)


def test_daily_views_are_dealt_by_what_is_read_and_not_by_the_sessions_partitions(spark):
    days = "date_add(date'2032-01-01', cast(id % 7 as int)) as date"
    raw = spark.range(0, 6000, 1, 3).selectExpr("if(id % 3 = 0, 'frwiki', 'enwiki') as wiki", "id % 40 as page_id", "cast(0 as tinyint) as access_method", "id as daily_views", days)
    articles = spark.range(30).selectExpr("if(id % 2 = 0, 'frwiki', 'enwiki') as wiki", "id as page_id", "id div 4 as qid", "'t' as page_title")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = ingest.daily_article_views(raw, articles).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    known, expected = {(r["wiki"], r["page_id"]): r["qid"] for r in articles.collect()}, {}
    for r in raw.collect():
        if (r["wiki"], r["page_id"]) in known:
            key = r["wiki"], r["date"], known[r["wiki"], r["page_id"]]
            expected[key] = expected.get(key, 0) + r["daily_views"]
    assert len(found) == len(expected) and {(r["wiki"], r["date"], r["article_qid"]): r["views"] for r in found} == expected
    assert len({r["task"] for r in found}) > 3 * 3


def test_articles_are_never_sent_whole_to_every_executor(spark, tmp_path):
    spark.range(100).selectExpr("'enwiki' as wiki", "id as page_id", "cast(0 as tinyint) as access_method", "id as daily_views", "date'2032-01-01' as date").write.parquet(f"{tmp_path}/raw")
    spark.range(200_000).selectExpr("'enwiki' as wiki", "id as page_id", "id div 10 as qid", "'t' as page_title").write.parquet(f"{tmp_path}/articles")
    found = ingest.daily_article_views(spark.read.parquet(f"{tmp_path}/raw"), spark.read.parquet(f"{tmp_path}/articles"))
    assert {r["article_qid"]: r["views"] for r in found.collect()} == {q: sum(range(10 * q, 10 * q + 10)) for q in range(10)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
