"""Layouts that save work: buckets without exchanges, clusters that a search skips."""

from __future__ import annotations

import math
import random

import pytest

from tests.conftest import rows
from tidemark.operators import nearest, titles, vectors, views
from tidemark.sources import bucketed


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(frame) -> int:
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_joins_on_a_bucketed_key_leave_the_dimension_where_it_is(spark, tmp_path, no_broadcast):
    data = [("enwiki", p, p % 90, f"t{p}") for p in range(200)]
    plain = spark.createDataFrame(data, "wiki string, page_id long, qid long, page_title string")
    dimension = bucketed.read_bucketed(spark, bucketed.write_bucketed(plain, str(tmp_path / "d"), "qid", 4))
    asked = spark.createDataFrame([(q,) for q in range(0, 120, 3)], "qid long")
    found = titles.titles_by_qids(asked, dimension)
    assert exchanges(found) == 1  # of the asked qids
    assert rows(found) == rows(titles.titles_by_qids(asked, plain))


def test_tops_over_buckets_move_only_sums_of_categories(spark, tmp_path, no_broadcast):
    daily = spark.createDataFrame([(a % 50, a % 7 + 1) for a in range(400)], "article_qid long, views long").selectExpr("*", "date'2032-01-05' as date")
    pairs = spark.createDataFrame([(a, a % 9) for a in range(50)], "article_qid long, category_qid long")
    own = [bucketed.read_bucketed(spark, bucketed.write_bucketed(t, str(tmp_path / n), "article_qid", 4)) for n, t in (("v", daily), ("p", pairs))]
    found = views.top_categories(*own, "2032-01-01", "2032-01-31", 5)
    assert exchanges(found) == 1
    assert rows(found) == rows(views.top_categories(daily, pairs, "2032-01-01", "2032-01-31", 5))


def made(seed, groups, spread, n):
    pick = random.Random(seed)
    middle = [[pick.gauss(0, 1) for _ in range(12)] for _ in range(groups)]
    return [(i, [x + pick.gauss(0, spread) for x in pick.choice(middle)]) for i in range(n)]


@pytest.mark.parametrize(("seed", "spread", "k"), [(1, 0.05, 3), (2, 1.0, 1), (3, 0.3, 500)])
def test_a_pruned_search_finds_what_a_search_over_all_finds(spark, tmp_path, seed, spread, k):
    data = made(seed, 8, spread, 300)
    data += [(1000 + i, data[i][1]) for i in range(20)] + [(2000, None), (2001, [0.0] * 12), (2002, [1.0])]  # copies tie
    table = spark.createDataFrame(data, "qid long, embedding array<double>")
    asked = spark.createDataFrame([*data[:25], (9000, None), (9001, [0.0] * 12), (9002, [-x for x in data[0][1]])], "query_id long, embedding array<double>")
    index = nearest.build_index(table, str(tmp_path / "i"), 16)
    assert index.sizes.sum() == 320
    found, scored = nearest.search(asked, index, k, block=10)
    want = vectors.most_similar(asked, table, k)
    assert rows(found.select("query_id", "qid", "score", "rank")) == rows(want.select("query_id", "qid", "score", "rank"))
    if spread == 0.05:
        assert scored < 26 * 320 / 3


def test_an_index_of_nothing(spark, tmp_path):
    table = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "qid long, embedding array<double>")
    index = nearest.build_index(table, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, [1.0, math.pi])], "query_id long, embedding array<double>")
    assert nearest.nearest(asked, index, 2).collect() == []


def test_a_bucket_is_written_by_several_tasks_and_still_read_without_an_exchange(spark, tmp_path, no_broadcast):
    plain = spark.range(400).selectExpr("'enwiki' as wiki", "id as page_id", "id % 90 as qid", "concat('t', id) as page_title")
    dimension = bucketed.read_bucketed(spark, bucketed.write_bucketed(plain, str(tmp_path / "d"), "qid", 2))  # 4 partitions in the session
    assert len(list((tmp_path / "d").glob("*.parquet"))) == 4
    assert rows(dimension) == rows(plain)
    summed = dimension.groupBy("qid").count()
    assert exchanges(summed) == 0 and rows(summed) == rows(plain.groupBy("qid").count())
