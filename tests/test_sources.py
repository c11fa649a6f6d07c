from __future__ import annotations

import json

import pytest

from tests.conftest import rows
from tidemark.operators import ingest
from tidemark.sources import daily, dumps, extract, tables
from tidemark.streaming.daily import stream_daily_views

LINES = """en.wikipedia Physics 11 desktop 100 A3B2
en.wikipedia Physics 11 mobile-web 40
fr.wikipedia Physique 12 mobile-app 7 X
en.wiktionary a 13 desktop 1
en.wikipedia X null desktop 5
too short
en.wikipedia Y 14 desktop 5.5
en.wikipedia Y 14 desktop 4294967296
zh-min-nan.wikipedia Z 15 desktop 2"""
NAME = "pageviews-20320101-user.txt"


def strings(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_dump_lines(spark, tmp_path):
    (tmp_path / NAME).write_text(LINES)
    found = dumps.read_pageview_dump(spark, str(tmp_path / NAME))
    assert [(r[0], r[1], r[2], r[3], str(r[4])) for r in rows(found)] == [
        ("en.wiktionary", 13, 0, 1, "2032-01-01"), ("enwiki", 11, 0, 100, "2032-01-01"), ("enwiki", 11, 1, 40, "2032-01-01"),
        ("frwiki", 12, -1, 7, "2032-01-01"), ("zh_min_nanwiki", 15, 0, 2, "2032-01-01"),
    ]


def test_a_dump_without_a_valid_line_is_an_error(spark, tmp_path):
    (tmp_path / NAME).write_text("too short\n")
    with pytest.raises(dumps.EmptyDump):
        dumps.read_pageview_dump(spark, str(tmp_path / NAME))


def test_replica_tsv(spark):
    lines = strings(spark, "page_id\tqid\ttitle", "1\t10\tA", "2\tNULL\tB", "3\t30", "4\t40\tD\textra")
    found = dumps.parse_replica_tsv(lines, ["page_id", "qid", "page_title"], {"page_id", "qid"})
    assert rows(found) == [(1, 10, "A"), (4, 40, "D")]


def test_editions(spark):
    names = strings(spark, "# comment wiki", "enwiki", "testwiki", "cebwiki", "aawiki", "enwikibooks", "frwiki", "enwiki")
    assert [r[0] for r in dumps.wiki_editions(names, strings(spark, "aawiki")).collect()] == ["enwiki", "frwiki"]
    matrix = {"sitematrix": {"count": 2, "specials": [], "0": {"code": "en", "name": "English", "site": [{"code": "wiki", "url": "u", "dbname": "enwiki"}]},
              "1": {"code": "aa", "name": "Afar", "site": [{"code": "wiki", "closed": ""}, {"code": "wiktionary", "dbname": "aawiktionary"}]}}}
    assert rows(dumps.site_matrix_editions(strings(spark, json.dumps(matrix)))) == [("en", "English", "enwiki", "u")]


def test_extraction(spark):
    page = spark.createDataFrame(
        [(1, 0, "A", 0, 0), (2, 0, "Redirect", 1, 0), (3, 0, "New", 0, 1), (4, 0, "No item", 0, 0), (5, 1, "Talk", 0, 0), (10, 14, "C", 0, 0), (11, 14, "D", 0, 0), (12, 14, "Hidden", 0, 0)],
        "page_id bigint, page_namespace int, page_title string, page_is_redirect int, page_is_new int",
    )
    items = [(p, "wikibase_item", f"Q{100 + p}") for p in (1, 2, 3, 5, 10, 11, 12)]
    props = spark.createDataFrame([*items, (12, "hiddencat", "")], "pp_page bigint, pp_propname string, pp_value string")
    targets = spark.createDataFrame([(1, 14, "C"), (2, 14, "D"), (3, 14, "Hidden"), (4, 14, "Missing"), (5, 0, "C")], "lt_id bigint, lt_namespace int, lt_title string")
    links = spark.createDataFrame(
        [(1, 1, "page"), (1, 3, "page"), (1, 4, "page"), (5, 1, "page"), (2, 1, "page"), (1, 2, "file"), (1, 5, "page"), (11, 1, "subcat"), (12, 1, "subcat")],
        "cl_from bigint, cl_target_id bigint, cl_type string",
    )
    articles, categories = extract.extract_articles(page, props), extract.extract_categories(page, props)
    assert rows(articles) == [(1, 101, "A")]
    assert rows(categories) == [(10, 110, "C"), (11, 111, "D")]
    assert rows(extract.extract_article_category(links, targets, page, articles, categories)) == [(101, 110)]
    assert rows(extract.extract_category_graph(links, targets, page, categories)) == [(110, 111)]


def articles(spark):
    return spark.createDataFrame([("enwiki", 11, 1, "Physics"), ("frwiki", 12, 1, "Physique")], "wiki string, page_id bigint, qid bigint, page_title string")


def test_a_day_taken_in_twice_is_the_same_and_the_stream_agrees_with_the_batch(spark, tmp_path):
    source = tmp_path / "dumps"
    source.mkdir()
    (source / NAME).write_text(LINES)
    batch = ingest.daily_article_views(dumps.read_pageview_dump(spark, str(source)), articles(spark))
    expected = sorted((r["wiki"], str(r["date"]), r["article_qid"], r["views"]) for r in batch.collect())
    assert expected == [("enwiki", "2032-01-01", 1, 140), ("frwiki", "2032-01-01", 1, 7)]
    for state in ("first", "again"):
        query = stream_daily_views(spark, str(source), articles(spark), str(tmp_path / "views"), str(tmp_path / state))
        query.awaitTermination()
        found = daily.scan_daily_views(spark, str(tmp_path / "views"), "2032-01-01", "2032-01-31")
        assert sorted((r["wiki"], str(r["date"]), r["article_qid"], r["views"]) for r in found.collect()) == expected


def test_backfill_writes_only_missing_days(spark, tmp_path):
    raw = spark.sql("select 'enwiki' as wiki, cast(11 as bigint) as page_id, cast(0 as tinyint) as access_method, cast(day(d) as bigint) as daily_views, d as date "
                    "from (select explode(sequence(date'2032-02-01', date'2032-02-29')) as d)")  # fmt: skip
    path = str(tmp_path / "views")
    daily.write_daily_views(ingest.daily_article_views(raw.where("day(date) <= 3").withColumn("daily_views", raw["daily_views"] * 100), articles(spark)), path)
    assert ingest.backfill_range(spark, raw, articles(spark), path, "2032-02-10").count() == 26
    found = {r["date"].day: r["views"] for r in daily.scan_daily_views(spark, path, "2032-02-01", "2032-02-29").collect()}
    assert found[2] == 200 and found[29] == 29 and len(found) == 29
    assert ingest.backfill_range(spark, raw, articles(spark), path, "2032-02-10").count() == 0


def test_vectors_are_upserted(spark, tmp_path):
    def batch(*data):
        return spark.createDataFrame(data, tables.schemas.CATEGORY_VECTORS)

    path = str(tmp_path / "vectors")
    tables.upsert_vectors(spark, path, batch(("enwiki", 1, "a", [1.0], 1), ("enwiki", 2, "b", [2.0], 1)))
    found = tables.upsert_vectors(spark, path, batch(("enwiki", 2, "c", [3.0], 2), ("enwiki", 3, "d", [4.0], 1)))
    assert rows(found.select("qid", "page_title")) == [(1, "a"), (2, "c"), (3, "d")]


def test_known_edges_and_pairs(spark):
    categories = spark.createDataFrame([("w", 1, 1, "a"), ("w", 2, 2, "b")], "wiki string, page_id bigint, qid bigint, page_title string")
    edges = spark.createDataFrame([("w", 1, 2), ("w", 1, 2), ("w", 1, 9), ("w", None, 2)], "wiki string, parent_qid bigint, child_qid bigint")
    assert tables.known_edges(edges, categories).count() == 2
    pairs = spark.createDataFrame([("w", 1, 2), ("w", 1, 2), ("w", 9, 2)], "wiki string, article_qid bigint, category_qid bigint")
    assert tables.known_pairs(pairs, categories, categories).count() == 1


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_the_partitions_and_columns_asked_for(spark, tmp_path):
    raw = spark.sql("select 'enwiki' as wiki, d as date, cast(1 as bigint) as article_qid, cast(2 as bigint) as views from (select explode(sequence(date'2032-01-01', date'2032-01-09')) as d)")
    path = str(tmp_path / "views")
    daily.write_daily_views(raw, path)
    found = tables.for_wiki(daily.scan_daily_views(spark, path, "2032-01-02", "2032-01-03"), "enwiki").select("views")
    text = plan(found)
    assert "PartitionFilters: [isnotnull(" in text and "ReadSchema: struct<views:bigint>" in text
    assert "(date#" in text.split("PartitionFilters")[1].split("PushedFilters")[0] and found.count() == 2
