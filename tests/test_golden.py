"""A small encyclopaedia whose category graph is a cycle, with results worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import delta, graph, ingest, titles, views
from tidemark.sources import dumps

DAY = "2032-10-12"


@pytest.fixture(scope="module")
def wiki(spark):
    def table(data, schema):
        return spark.createDataFrame(data, schema)

    parsed = table(
        [("test.wikipedia", p, m, v) for p, m, v in ((1, "desktop", 100), (2, "desktop", 200), (3, "desktop", 300), (2, "mobile-web", 500), (4, "desktop", 600))],
        "domain string, page_id bigint, access_method string, daily_views bigint",
    ).withColumn("date", F.lit(DAY).cast("date"))
    articles = table([("testwiki", i, i, f"Article {i}" if i < 4 else "Article_4") for i in range(1, 5)], "wiki string, page_id bigint, qid bigint, page_title string")
    categories = table([("testwiki", i, i, f"Category {i}") for i in range(1, 4)], "wiki string, page_id bigint, qid bigint, page_title string")
    return {
        "articles": articles,
        "categories": categories,
        "pairs": table([(1, 1), (2, 1), (3, 2), (4, 3)], "article_qid bigint, category_qid bigint"),
        "edges": table([(1, 2), (2, 3), (3, 1)], "parent_qid bigint, child_qid bigint"),
        "daily": ingest.daily_article_views(dumps.normalize_pageviews(parsed), articles),
    }


def roots(spark, *qids):
    return spark.createDataFrame([(q,) for q in qids], "root bigint")


def mask(spark, wiki, depth, *qids):
    return graph.articles_in_category(roots(spark, *qids), wiki["categories"], wiki["edges"], wiki["pairs"], depth)


@pytest.mark.parametrize(("depth", "n"), [(0, 2), (1, 3), (None, 4)])
def test_articles_in_category(spark, wiki, depth, n):
    assert mask(spark, wiki, depth, 1).count() == n


@pytest.mark.parametrize(("root", "depth", "total"), [(1, 0, 800), (1, 1, 1100), (1, None, 1700), (2, 1, 900), (3, 1, 1400)])
def test_category_trend(spark, wiki, root, depth, total):
    found = views.masked_trend(mask(spark, wiki, depth, root), wiki["daily"], DAY, DAY)
    assert rows(found) == [(root, dt.date(2032, 10, 12), total)]


def test_days_without_views_are_zero_and_unknown_roots_are_empty(spark, wiki):
    found = views.masked_trend(mask(spark, wiki, 0, 1, 99), wiki["daily"], "2032-10-11", "2032-10-13")
    assert [r[2] for r in rows(found)] == [0, 800, 0]
    assert {r[0] for r in rows(found)} == {1}


def test_article_trend_sums_access_methods(spark, wiki):
    asked = spark.createDataFrame([(2,), (77,)], "article_qid bigint")
    assert [r[2] for r in rows(views.article_trend(asked, wiki["articles"], wiki["daily"], DAY, DAY))] == [700]


def test_top_categories(spark, wiki):
    found = views.top_categories_nested(wiki["daily"], wiki["pairs"], DAY, DAY, 10).orderBy(F.desc("total_views")).collect()
    assert [(r[0], r[1], [tuple(a) for a in r[2]]) for r in found] == [(1, 800, [(2, 700), (1, 100)]), (3, 600, [(4, 600)]), (2, 300, [(3, 300)])]
    trending = views.trending_articles(views.top_categories_nested(wiki["daily"], wiki["pairs"], DAY, DAY, 10)).collect()
    assert [r[0] for r in trending] == [2, 4, 3, 1]


def test_top_articles_total_is_that_of_the_kept(spark, wiki):
    assert rows(views.top_articles(mask(spark, wiki, 0, 1), wiki["daily"], DAY, DAY, 1)) == [(1, 2, 700, 1, 700)]


def test_neighbours(spark, wiki):
    assert rows(graph.child_categories(spark.createDataFrame([(1,)], "parent_qid bigint"), wiki["edges"])) == [(1, 2)]
    assert rows(graph.parent_categories(spark.createDataFrame([(1,)], "child_qid bigint"), wiki["edges"])) == [(1, 3)]
    assert rows(graph.article_categories(spark.createDataFrame([(2,)], "article_qid bigint"), wiki["pairs"])) == [(2, 1)]
    assert rows(graph.descendant_categories(roots(spark, 1), wiki["categories"], wiki["edges"], 2)) == [(1, 2, 1), (1, 3, 2)]


def test_depth_stats_and_unknown_root(spark, wiki):
    found = rows(graph.category_depth_stats(roots(spark, 1, 9), wiki["categories"], wiki["edges"]))
    assert found == [(1, 2, 1.0, 3, 0), (9, 0, 0.0, 0, 0)]


def test_categories_trend_counts_shared_articles_again(spark, wiki):
    both = mask(spark, wiki, 1, 1, 2)
    assert [r[1] for r in rows(views.categories_trend(both, wiki["daily"], DAY, DAY))] == [2000]
    assert [r[1] for r in rows(views.categories_trend(both, wiki["daily"], DAY, DAY, distinct_articles=True))] == [1700]
    top = views.categories_top_articles(both, wiki["daily"], DAY, DAY).collect()
    assert [tuple(r) for r in top] == [(2, 700), (3, 600), (4, 600), (1, 100)]


@pytest.mark.parametrize("mode", ["consistent", "reference"])
def test_category_delta(wiki, mode):
    days = ("2032-10-11", "2032-10-11"), (DAY, DAY)
    found = delta.category_delta(wiki["categories"], wiki["edges"], wiki["pairs"], wiki["daily"], *days, mode=mode).collect()
    assert [tuple(r) for r in found] == [(1, 0, 800, 100.0, 800), (3, 0, 600, 100.0, 600), (2, 0, 300, 100.0, 300)]


def test_titles_fall_back_to_the_id(spark, wiki):
    asked = spark.createDataFrame([(1,), (50,)], "qid bigint")
    assert rows(titles.with_title(asked, wiki["articles"], "qid")) == [(1, "Article 1"), (50, "Q50")]
    assert rows(titles.with_known_title(asked, wiki["articles"], "qid")) == [(1, "Article 1")]
    assert titles.title_map(titles.titles(wiki["articles"]).withColumn("g", F.lit(0)), "g").first()[1][4] == "Article_4"
