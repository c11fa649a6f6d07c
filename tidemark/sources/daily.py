"""The table of daily views: a partition for each edition and day, month sums beside it, and the days that were taken in.

Days, months and taken days change in one commit (see ``manifest``). A day that was taken in and has no rows is taken all the same.
Sums over a long range read whole months as one partition each, and only the days at its edges.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import schemas
from tidemark.sources.manifest import Manifest, new_generation

MONTHLY_VIEWS = "wiki string, month date, article_qid bigint, views bigint"
TASK_ROWS = 1_000_000
"""Rows of days that a task sums to months."""


def _part_day(name: str) -> Column:
    """The day or month in a partition's name."""
    return F.regexp_extract("part", rf"{name}=([0-9-]{{10}})", 1).cast("date")


def _between(day: Column, start: str | date, end: str | date) -> Column:
    return day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def month_sums(rows: DataFrame) -> DataFrame:
    """(wiki, month, article_qid, views) of daily views, each task with a range of the articles of one month or of the months that follow it.

    Rows are dealt by range once, to as many tasks as hold ``TASK_ROWS`` each, for the sums and for writing them: what a task holds follows
    neither the size of the table or of a month nor adaptive planning.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    key = ["wiki", "month", "article_qid"]
    dealt = rows.select("wiki", F.trunc("date", "month").alias("month"), "article_qid", "views").repartitionByRange(tasks, *key)
    return dealt.groupBy(*key).agg(F.sum("views").alias("views"))


def write_daily_views(table: DataFrame, path: str, taken: Iterable[date] = ()) -> None:
    """Replaces the partitions (wiki, date) that ``table`` has rows of, sums their months anew, and commits both.

    ``taken`` are days that count as taken in though they may have no rows.
    """
    spark, generation = table.sparkSession, new_generation()
    before = Manifest.latest(spark, path)
    after = before.write("days", table.select("article_qid", "views", "wiki", "date"), ["wiki", "date"], generation)
    new = after.rows.where(F.col("kind") == "days").where(F.col("generation") == generation)
    days = {r["day"] for r in new.select(_part_day("date").alias("day")).distinct().collect()}
    months = sorted({d.replace(day=1) for d in days})
    if months:
        wanted = [F.trunc(day, "month").isin(months) for day in (_part_day("date"), F.col("date"))]
        sums = month_sums(after.scan("days", schemas.DAILY_VIEWS, *wanted))
        after = after.write("months", sums.select("article_qid", "views", "wiki", "month"), ["wiki", "month"], generation, dealt=True)
    after.put("taken", [f"date={d}" for d in days | set(taken)], generation).commit()


def scan_daily_views(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """(wiki, date, article_qid, views) of the days from start to end that exist; only their folders are read."""
    return Manifest.latest(spark, path).scan("days", schemas.DAILY_VIEWS, _between(_part_day("date"), start, end), _between(F.col("date"), start, end))


def all_daily_views(spark: SparkSession, path: str) -> DataFrame:
    return Manifest.latest(spark, path).scan("days", schemas.DAILY_VIEWS)


def taken_days(spark: SparkSession, path: str) -> DataFrame:
    """(date) of the days that were taken in, with or without rows."""
    return Manifest.latest(spark, path).rows.where("kind = 'taken'").select(_part_day("date").alias("date"))


def _next_month(day: date) -> date:
    return (day.replace(day=1) + timedelta(days=32)).replace(day=1)


def split_ranges(ranges: Iterable[tuple[date, date]]) -> tuple[list[date], list[tuple[date, date]]]:
    """The months, and the stretches of other days, that together are the days of the ranges.

    A month is whole where each range has all of it or none. Stretches are cut where a range begins or ends and at months' ends.
    """
    ranges = [(a, b) for a, b in ranges if a <= b]
    months: list[date] = []
    stretches: list[tuple[date, date]] = []
    for month in sorted({m for a, b in ranges for m in _months(a, b)}):
        last = _next_month(month) - timedelta(days=1)
        inside = [(max(a, month), min(b, last)) for a, b in ranges if a <= last and b >= month]
        if all(r == (month, last) for r in inside):
            months.append(month)
            continue
        cuts = sorted({a for a, _ in inside} | {b + timedelta(days=1) for _, b in inside})
        stretches += [(a, b - timedelta(days=1)) for a, b in zip(cuts, cuts[1:], strict=False) if any(x <= a and b - timedelta(days=1) <= y for x, y in inside)]
    return months, stretches


def _months(start: date, end: date) -> list[date]:
    out = [start.replace(day=1)]
    while _next_month(out[-1]) <= end:
        out.append(_next_month(out[-1]))
    return out


def scan_range_views(spark: SparkSession, path: str, *ranges: tuple[str, str]) -> DataFrame:
    """(wiki, date, article_qid, views) whose sums over any of the ranges are those of their days.

    Months that every range has whole or not at all are one row an article, dated at their first day, from the month sums; other days
    are read as they are. For sums over these ranges only, not for series of days.
    """
    months, stretches = split_ranges([(date.fromisoformat(a), date.fromisoformat(b)) for a, b in ranges])
    state = Manifest.latest(spark, path)
    whole = state.scan("months", MONTHLY_VIEWS, *(_any([m == F.lit(x).cast("date") for x in months]) for m in (_part_day("month"), F.col("month"))))
    rest = state.scan("days", schemas.DAILY_VIEWS, *(_any([_between(d, a, b) for a, b in stretches]) for d in (_part_day("date"), F.col("date"))))
    return whole.select("wiki", F.col("month").alias("date"), "article_qid", "views").unionByName(rest.select("wiki", "date", "article_qid", "views"))
