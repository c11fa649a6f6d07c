"""From raw pageviews to daily views per article, for all editions and days in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import month_days
from tidemark.sources import daily

DEALT = 8
"""Tasks that the rows of a partition read are dealt to."""


def daily_article_views(pageviews: DataFrame, articles: DataFrame) -> DataFrame:
    """(wiki, date, article_qid, views): views summed over access methods and over pages of one qid.

    Pages that are no known article are dropped. An edition or day without pageviews has no rows. Rows are dealt to ``DEALT`` tasks for each
    partition that ``pageviews`` is read in, so what a task holds follows the size of a partition and not that of the table or the session's settings.
    The articles are dealt and sorted as the rows are: by the size of their compressed file Spark would send millions of them whole to every executor.
    """
    tasks = DEALT * max(1, pageviews.rdd.getNumPartitions())
    known = articles.select("wiki", "page_id", F.col("qid").alias("article_qid"))
    found = pageviews.repartition(tasks, "wiki", "page_id").join(known.hint("merge"), ["wiki", "page_id"])
    return found.repartition(tasks, "wiki", "date", "article_qid").groupBy("wiki", "date", "article_qid").agg(F.sum("daily_views").alias("views"))


def missing_days(spark: SparkSession, end_date: str, existing: DataFrame) -> DataFrame:
    """Days of the month of ``end_date`` that ``existing`` has no row of."""
    month = spark.range(1).select(F.explode(month_days(F.lit(end_date).cast("date"))).alias("date"))
    return month.join(existing.select("date").distinct(), "date", "left_anti")


def backfill_range(spark: SparkSession, pageviews: DataFrame, articles: DataFrame, path: str, end_date: str) -> DataFrame:
    """Takes in the month's days that the table at ``path`` has not taken in, in one commit, and returns them; what is there stays.

    A day without any pageviews counts as taken in from then on.
    """
    wanted = [r["date"] for r in missing_days(spark, end_date, daily.taken_days(spark, path)).collect()]  # at most 31
    if wanted:
        new = daily_article_views(pageviews.where(F.col("date").isin(wanted)), articles)
        daily.write_daily_views(new, path, wanted)
    return spark.createDataFrame([(d,) for d in wanted], "date date")
