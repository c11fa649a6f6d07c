"""The table of daily views: commits, taken days, month sums, vectors by bucket, and the stream."""

from __future__ import annotations

import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import ingest, views
from tidemark.sources import daily, manifest, schemas, tables
from tidemark.streaming.daily import stream_daily_views


def table(spark, start, end, wiki="enwiki", times=1, articles=3):
    """Views of some articles on all days of a range."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    days = [first + timedelta(days=i) for i in range((last - first).days + 1)]
    return spark.createDataFrame([(wiki, d, a, times * (d.day + a)) for d in days for a in range(articles)], schemas.DAILY_VIEWS)


def read(frame):
    return sorted((r["wiki"], str(r["date"]), r["article_qid"], r["views"]) for r in frame.collect())


def test_a_commit_that_never_came_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "views")
    assert daily.all_daily_views(spark, path).collect() == []
    daily.write_daily_views(table(spark, "2032-01-30", "2032-02-02"), path)
    before = read(daily.all_daily_views(spark, path))
    months = read(daily.scan_range_views(spark, path, ("2032-01-01", "2032-02-29")))

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(manifest, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            daily.write_daily_views(table(spark, "2032-02-01", "2032-02-05", times=10), path)
    assert read(daily.all_daily_views(spark, path)) == before
    assert read(daily.scan_range_views(spark, path, ("2032-01-01", "2032-02-29"))) == months
    daily.write_daily_views(table(spark, "2032-02-01", "2032-02-05", times=10), path)
    expected = read(table(spark, "2032-01-30", "2032-01-31").unionByName(table(spark, "2032-02-01", "2032-02-05", times=10)))
    assert read(daily.all_daily_views(spark, path)) == expected
    state = manifest.Manifest.latest(spark, path)
    assert len(state.vacuum()) >= 3 and read(daily.all_daily_views(spark, path)) == expected


def test_of_two_writers_from_one_state_the_second_fails(spark, tmp_path):
    path = str(tmp_path / "views")
    daily.write_daily_views(table(spark, "2032-01-01", "2032-01-02"), path)
    states = [manifest.Manifest.latest(spark, path).put("taken", [f"date=2032-03-0{i}"], "g") for i in (1, 2)]
    states[0].commit()
    with pytest.raises(Exception, match="exist"):
        states[1].commit()
    assert {str(r["date"]) for r in daily.taken_days(spark, path).collect()} == {"2032-01-01", "2032-01-02", "2032-03-01"}


def test_an_empty_day_is_filled_once(spark, tmp_path):
    articles = spark.createDataFrame([("enwiki", 11, 1, "a")], schemas.DIMENSION)
    raw = spark.createDataFrame([("enwiki", 11, 0, 5, date(2032, 2, d)) for d in (1, 2, 9)], schemas.PAGEVIEWS_RAW)
    path = str(tmp_path / "views")
    assert ingest.backfill_range(spark, raw, articles, path, "2032-02-10").count() == 29
    assert ingest.backfill_range(spark, raw, articles, path, "2032-02-10").count() == 0
    assert [r["date"].day for r in daily.all_daily_views(spark, path).orderBy("date").collect()] == [1, 2, 9]


def test_ranges_split_into_months_and_other_days():
    pick = random.Random(1)
    for _ in range(300):
        ranges = []
        for _ in range(pick.choice((1, 2, 3))):
            a = date(2031, 11, 1) + timedelta(days=pick.randrange(150))
            ranges.append((a, a + timedelta(days=pick.randrange(-2, 120))))
        months, stretches = daily.split_ranges(ranges)
        pieces = [(m, daily._next_month(m) - timedelta(days=1)) for m in months] + stretches
        found = [a + timedelta(days=i) for a, b in pieces for i in range((b - a).days + 1)]
        assert len(found) == len(set(found))
        assert set(found) == {a + timedelta(days=i) for a, b in ranges for i in range((b - a).days + 1)}
        for a, b in pieces:  # each lies in a range as a whole or not at all
            assert all(x <= a and b <= y or b < x or y < a for x, y in ranges if x <= y)
    assert daily.split_ranges([(date(2032, 1, 1), date(2032, 12, 31))]) == ([date(2032, m, 1) for m in range(1, 13)], [])


def test_a_year_is_read_from_twelve_month_folders(spark, tmp_path):
    path = str(tmp_path / "views")
    daily.write_daily_views(table(spark, "2031-12-01", "2033-01-31", articles=1), path)
    daily.write_daily_views(table(spark, "2032-03-05", "2032-03-06", times=7, articles=1), path)
    whole = daily.all_daily_views(spark, path)
    found = daily.scan_range_views(spark, path, ("2032-01-01", "2032-12-31"))
    assert len({f.rsplit("/", 1)[0] for f in found.inputFiles() if "month=2032" in f}) == 12 and found.count() == 12
    for span in (("2032-01-01", "2032-12-31"), ("2031-12-15", "2032-04-02"), ("2032-02-02", "2032-02-20")):
        assert rows(views.totals(daily.scan_range_views(spark, path, span), *span)) == rows(views.totals(whole, *span))
    both = ("2032-01-01", "2032-03-31"), ("2032-03-01", "2032-05-15")
    found = daily.scan_range_views(spark, path, *both)
    assert [rows(views.totals(found, *span)) for span in both] == [rows(views.totals(whole, *span)) for span in both]
    assert daily.scan_range_views(spark, path, ("2040-01-01", "2040-12-31")).collect() == []


def test_vectors_of_few_buckets_write_few_files(spark, tmp_path):
    def batch(qids, version):
        return spark.createDataFrame([("enwiki", q, f"t{q}v{version}", [float(q)], version) for q in qids], schemas.CATEGORY_VECTORS)

    path = str(tmp_path / "vectors")
    tables.upsert_vectors(spark, path, batch(range(400), 1), buckets=50)
    files = {f for f in os.popen(f"find {path}/vectors -name '*.parquet'").read().split()}
    found = tables.upsert_vectors(spark, path, batch([7, 1007], 2))
    new = set(os.popen(f"find {path}/vectors -name '*.parquet'").read().split()) - files
    assert 0 < len(new) <= 2
    expected = {q: f"t{q}v1" for q in range(400)} | {7: "t7v2", 1007: "t1007v2"}
    assert {r["qid"]: r["page_title"] for r in found.collect()} == expected
    old = tables.upsert_vectors(spark, path, batch([7], 1))  # an older version changes nothing
    assert {r["qid"]: r["page_title"] for r in old.collect()} == expected


def dump(folder, day, *lines):
    folder.mkdir(exist_ok=True)
    (folder / f"pageviews-{day}").write_text("".join(f"en.wikipedia T {page} desktop {n}\n" for page, n in lines))


def test_the_stream_adds_late_files_and_leaves_out_repeated_and_too_late_ones(spark, tmp_path):
    articles = spark.createDataFrame([("enwiki", 11, 1, "a"), ("enwiki", 12, 1, "b"), ("enwiki", 13, 2, "c")], schemas.DIMENSION)
    source = tmp_path / "dumps"
    source.mkdir()

    def run():
        stream_daily_views(spark, str(source), articles, str(tmp_path / "views"), str(tmp_path / "state"), late="10 days", files_at_once=2).awaitTermination()
        return [(d[5:], a, n) for _, d, a, n in read(daily.all_daily_views(spark, str(tmp_path / "views")))]

    assert run() == []
    for day in (1, 2, 3):
        dump(source / "a", f"203201{day:02}", (11, 5), (12, day), (13, 1), (99, 7))
    assert run() == [(f"01-0{d}", a, n) for d in (1, 2, 3) for a, n in ((1, 5 + d), (2, 1))]
    dump(source / "b", "20320102", (11, 1000))  # the name was there before
    dump(source / "b", "20320120", (13, 9))
    expected = [(f"01-0{d}", a, n) for d in (1, 2, 3) for a, n in ((1, 5 + d), (2, 1))] + [("01-20", 2, 9)]
    assert run() == expected
    (source / "b" / "late-20320115").write_text("en.wikipedia T 11 desktop 4\n")
    (source / "b" / "more-20320120").write_text("en.wikipedia T 13 desktop 1\n")
    (source / "b" / "late-20320102").write_text("en.wikipedia T 13 desktop 100\n")  # further back than the watermark
    assert run() == [*expected[:-1], ("01-15", 1, 4), ("01-20", 2, 10)]
    assert read(daily.scan_range_views(spark, str(tmp_path / "views"), ("2032-01-01", "2032-01-31"))) == [("enwiki", "2032-01-01", 1, 25), ("enwiki", "2032-01-01", 2, 13)]


def test_days_of_one_edition_leave_those_of_another(spark, tmp_path):
    path = str(tmp_path / "views")
    daily.write_daily_views(table(spark, "2032-01-01", "2032-01-02").unionByName(table(spark, "2032-01-01", "2032-01-02", "frwiki")), path)
    daily.write_daily_views(table(spark, "2032-01-02", "2032-01-02", "frwiki", 5), path)
    found = daily.scan_daily_views(spark, path, "2032-01-02", "2032-01-02").groupBy("wiki").agg(F.sum("views"))
    assert rows(found) == [("enwiki", 9), ("frwiki", 45)]


def test_the_streams_sums_are_kept_on_disk_and_the_sessions_settings_stay(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    articles, before = spark.createDataFrame([("enwiki", 11, 1, "a")], schemas.DIMENSION), spark.conf.get(key)
    for day in (1, 2):
        dump(tmp_path / "dumps", f"203201{day:02}", (11, 5))
    query = stream_daily_views(spark, str(tmp_path / "dumps"), articles, str(tmp_path / "views"), str(tmp_path / "state"))
    query.awaitTermination()
    assert spark.conf.get(key) == before
    assert any("rocksdbPinnedBlocksMemoryUsage" in o["customMetrics"] for p in query.recentProgress for o in p["stateOperators"])
    assert read(daily.all_daily_views(spark, str(tmp_path / "views"))) == [("enwiki", "2032-01-01", 1, 5), ("enwiki", "2032-01-02", 1, 5)]


def test_a_months_sums_are_dealt_by_their_rows_and_not_by_folder_or_settings(spark, tmp_path, monkeypatch):
    path, raw = str(tmp_path / "views"), table(spark, "2032-01-01", "2032-02-29", articles=40)
    monkeypatch.setattr(daily, "TASK_ROWS", 100, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        daily.write_daily_views(raw, path)
        found = daily.scan_range_views(spark, path, ("2032-01-01", "2032-02-29")).withColumn("file", F.input_file_name()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = {}
    for r in raw.collect():
        key = r["date"].replace(day=1), r["article_qid"]
        expected[key] = expected.get(key, 0) + r["views"]
    assert len(found) == len(expected) and {(r["date"], r["article_qid"]): r["views"] for r in found} == expected
    sizes = [sum(r["file"] == f for r in found) for f in {r["file"] for r in found}]
    assert len(sizes) > 10 and max(sizes) <= 10  # 2,400 rows of days in 24 tasks, 80 sums
    assert daily.month_sums(raw)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
