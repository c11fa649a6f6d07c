from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.functions import columns
from tidemark.operators import graph, vectors, views

WALK = """WITH RECURSIVE w AS (SELECT r AS root, r AS node, 0 AS depth FROM roots UNION
  SELECT w.root, e.child, w.depth + 1 FROM w JOIN edges AS e ON e.parent = w.node WHERE w.depth < {depth})
  SELECT root, node, min(depth) FROM w GROUP BY root, node"""


@pytest.mark.parametrize(("seed", "depth"), [(0, 1), (1, 3), (2, None)])
def test_descend_equals_recursive_sql(spark, seed, depth):
    random = np.random.default_rng(seed)
    edges = sorted({(int(a), int(b)) for a, b in random.integers(0, 25, (40, 2))})
    c = duckdb.connect()
    c.execute("CREATE TABLE edges AS SELECT * FROM (VALUES " + ",".join(map(str, edges)) + ") AS t(parent, child)")
    c.execute("CREATE TABLE roots AS SELECT * FROM (VALUES (0), (3), (7)) AS t(r)")
    frame = spark.createDataFrame(edges, "parent_qid bigint, child_qid bigint")
    found = graph.descend(spark.createDataFrame([(0,), (3,), (7,)], "root bigint"), frame, depth)
    expected = c.execute(WALK.format(depth=30 if depth is None else depth)).fetchall()
    assert rows(found) == sorted(expected, key=str)


def test_trends_agree_with_their_articles(spark):
    random = np.random.default_rng(5)
    daily = spark.createDataFrame([(int(a), int(d), int(v)) for a, d, v in zip(random.integers(1, 20, 300), random.integers(1, 20, 300), random.integers(1, 90, 300), strict=True)], "article_qid bigint, d int, views bigint")
    daily = daily.groupBy("article_qid", "d").agg(F.sum("views").alias("views")).selectExpr("article_qid", "make_date(2032, 1, d) as date", "views")
    articles = spark.createDataFrame([("w", q, q, "t") for q in range(1, 20)], "wiki string, page_id bigint, qid bigint, page_title string")
    mask = spark.createDataFrame([(1, q) for q in range(1, 10)], "root bigint, article_qid bigint")
    total = views.masked_trend(mask, daily, "2032-01-01", "2032-01-31").agg(F.sum("views")).first()[0]
    each = views.article_trend(mask.select("article_qid"), articles, daily, "2032-01-01", "2032-01-31").agg(F.sum("views")).first()[0]
    assert total == each
    ranked = [tuple(r) for r in views.top_articles(mask, daily, "2032-01-01", "2032-01-31", 99).orderBy("rank").select("article_qid", "views").collect()]
    assert ranked == sorted(ranked, key=lambda r: (-r[1], r[0]))
    assert [r[0] for r in views.top_articles(mask, daily, "2032-01-01", "2032-01-31", 3).orderBy("rank").select("article_qid").collect()] == [r[0] for r in ranked[:3]]


def test_vector_search(spark):
    vecs = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 1.0]), (3, "c", [0.0, 2.0]), (4, None, [1.0, 0.1]), (5, "zero", [0.0, 0.0])], "qid bigint, page_title string, embedding array<float>")
    asked = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 1.0])], "query_id bigint, embedding array<float>")
    best = rows(vectors.most_similar(asked, vecs, 2).select("query_id", "qid", "score"))
    assert best == [(7, 1, 1.0), (7, 4, pytest.approx(0.995037)), (8, 2, pytest.approx(0.707107)), (8, 3, 1.0)]
    assert rows(vectors.search_categories(asked, vecs).select("query_id", "qid")) == [(7, 1), (7, 2), (8, 2), (8, 3)]
    assert rows(vectors.similarity_matrix(asked, vecs, block=1)) == rows(vectors.similarity_matrix(asked, vecs))


def test_encoder_gets_batches(spark):
    def encoder():
        return lambda texts, prompt: [[float(len(t)), float(len(texts))] for t in texts]

    table = spark.range(250).selectExpr("id", "repeat('x', cast(id as int)) as t").coalesce(1)
    found = vectors.encode_texts(table, "t", encoder, batch=100).orderBy("id").collect()
    assert [r["embedding"][0] for r in found[:3]] == [0.0, 1.0, 2.0]
    assert {r["embedding"][1] for r in found} == {100.0, 50.0}


def test_column_functions(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c).first()[0]

    assert [value(columns.u32(F.lit(x))) for x in ("5", " 5", "-5", "5.5", "4294967295", "4294967296", "", "9" * 30)] == [5, None, None, None, 4294967295, None, None, None]
    assert value(columns.strip_q(F.lit("Q42"))) == 42 and value(columns.strip_q(F.lit("Qx"))) is None
    assert [value(columns.delta_percentage(F.lit(b), F.lit(i))) for b, i in ((0, 0), (0, 5), (4, 6), (4, 0))] == [0.0, 100.0, 50.0, -100.0]
    assert len(value(columns.month_days(F.lit("2032-02-10").cast("date")))) == 29
    assert value(columns.strip_namespace(F.lit("Category: Deep: Blue"))) == "Blue"
    assert value(columns.lossy_text(F.lit(bytearray(b"a\xff")))) == "a�"
    assert value(columns.period_label(F.lit("2032-01-01").cast("date"), F.lit("2032-01-02").cast("date"))) == "2032-01-01 to 2032-01-02"
    assert value(columns.day(F.lit("2032-13-01"), strict=False)) is None
