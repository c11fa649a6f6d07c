"""Trends, totals and rankings over daily views of one edition.

``daily`` is daily views, ``pairs`` the distinct article-category pairs, both of one edition; ties go to the smaller qid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import days
from tidemark.operators.graph import article_bits, articles_in_category


MOST_BROADCAST = 100_000


def few(table: DataFrame, n: int) -> DataFrame:
    """A result of at most n rows, to be broadcast where that is few."""
    return F.broadcast(table) if n <= MOST_BROADCAST else table


def in_range(daily: DataFrame, start: str, end: str) -> DataFrame:
    return daily.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def totals(daily: DataFrame, start: str, end: str) -> DataFrame:
    """(article_qid, views) summed over the range, before any fan-out."""
    return in_range(daily, start, end).groupBy("article_qid").agg(F.sum("views").alias("views"))


def calendar_fill(series: DataFrame, keys: DataFrame, start: str, end: str) -> DataFrame:
    """(key, date, views): the sums of ``series``, and 0 on every other day of the range, for each distinct key.

    The calendar is made, not read: a zero for each key and day joins the rows before the one aggregation that sums them.
    """
    name = keys.columns[0]
    zeros = keys.select(name, F.explode(days(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"), F.lit(0).cast("bigint").alias("views"))
    return series.select(name, "date", "views").unionByName(zeros).groupBy(name, "date").agg(F.sum("views").alias("views"))


def masked_trend(mask: DataFrame, daily: DataFrame, start: str, end: str) -> DataFrame:
    """(root, date, views): daily sums over the articles of each root, all days; a root without articles has no rows."""
    found = in_range(daily, start, end).join(mask, "article_qid")
    return calendar_fill(found, mask.select("root").distinct(), start, end)


def category_trend(roots: DataFrame, categories: DataFrame, edges: DataFrame, pairs: DataFrame, daily: DataFrame, depth: int | None, start: str, end: str) -> DataFrame:
    """(root, date, views) over the articles of each root to ``depth``."""
    return masked_trend(articles_in_category(roots, categories, edges, pairs, depth), daily, start, end)


def article_trend(asked: DataFrame, articles: DataFrame, daily: DataFrame, start: str, end: str) -> DataFrame:
    """(article_qid, date, views) of the asked articles, all days; an unknown article has no rows."""
    known = asked.select("article_qid").distinct().join(articles.select(F.col("qid").alias("article_qid")), "article_qid", "left_semi")
    found = in_range(daily, start, end).join(known, "article_qid", "left_semi")
    return calendar_fill(found, known, start, end)


def category_totals(daily: DataFrame, pairs: DataFrame, start: str, end: str) -> DataFrame:
    """(category_qid, total_views) of direct members: views are summed per article first, then spread to its categories."""
    spread = totals(daily, start, end).join(pairs, "article_qid")
    return spread.groupBy("category_qid").agg(F.sum("views").alias("total_views"))


def top_categories(daily: DataFrame, pairs: DataFrame, start: str, end: str, n: int = 10) -> DataFrame:
    """(category_qid, total_views) of the n categories with the most views, without those that have none."""
    ranked = category_totals(daily, pairs, start, end).orderBy(F.desc("total_views"), "category_qid").limit(n)
    return ranked.where("total_views > 0")


def ranked_categories(daily: DataFrame, pairs: DataFrame, start: str, end: str, n: int = 10) -> DataFrame:
    """``top_categories`` with its rank and the mean views of a day."""
    order = Window.orderBy(F.desc("total_views"), "category_qid")
    length = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    return top_categories(daily, pairs, start, end, n).select(
        F.row_number().over(order).alias("rank"), "category_qid", "total_views", (F.col("total_views") / length).alias("daily_average")
    )


def top_members(roots: DataFrame, pairs: DataFrame, article_views: DataFrame, n: int) -> DataFrame:
    """(category_qid, article_qid, views, rank): the n articles with the most views of each asked category, none without views.

    The asked categories are at most n as well (the result of a limit) and narrow the pairs before views are joined.
    """
    own = pairs.join(few(roots.select("category_qid"), n), "category_qid", "left_semi")
    order = Window.partitionBy("category_qid").orderBy(F.desc("views"), "article_qid")
    found = own.join(article_views.where("views > 0"), "article_qid").withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= n).select("category_qid", "article_qid", "views", "rank")


def top_categories_nested(daily: DataFrame, pairs: DataFrame, start: str, end: str, n: int = 10) -> DataFrame:
    """(category_qid, total_views, top_articles): each of the top categories with its n articles of most views, in order."""
    best = top_categories(daily, pairs, start, end, n)
    members = top_members(best, pairs, totals(daily, start, end), n)
    lists = members.groupBy("category_qid").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "article_qid", "views"))),
            lambda x: F.struct(x["article_qid"].alias("article_qid"), x["views"].alias("total_views")),
        ).alias("top_articles")
    )
    return best.join(lists, "category_qid", "left").select("category_qid", "total_views", "top_articles")


def unnested(nested: DataFrame) -> DataFrame:
    """(category_qid, total_views, rank, article_qid, article_views) of a nested ranking."""
    return nested.select("category_qid", "total_views", F.posexplode("top_articles").alias("rank", "a")).select(
        "category_qid", "total_views", (F.col("rank") + 1).alias("rank"), "a.article_qid", F.col("a.total_views").alias("article_views")
    )


def top_articles(mask: DataFrame, daily: DataFrame, start: str, end: str, n: int) -> DataFrame:
    """(root, article_qid, views, rank, total_views) of the n articles with the most views of each root.

    ``total_views`` is the sum of the articles kept. Articles without views are left out.
    """
    seen = totals(daily, start, end).where("views > 0").join(mask, "article_qid")
    order = Window.partitionBy("root").orderBy(F.desc("views"), "article_qid")
    kept = seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    total = F.sum("views").over(Window.partitionBy("root")).alias("total_views")
    return kept.select("root", "article_qid", "views", "rank", total)


def top_articles_in_category(roots: DataFrame, categories: DataFrame, edges: DataFrame, pairs: DataFrame, daily: DataFrame, depth: int | None, start: str, end: str, n: int = 10) -> DataFrame:
    return top_articles(articles_in_category(roots, categories, edges, pairs, depth), daily, start, end, n)


def categories_trend(mask: DataFrame, daily: DataFrame, start: str, end: str, distinct_articles: bool = False) -> DataFrame:
    """(date, views) summed over all roots of the mask; an article in several counts several times unless ``distinct_articles``."""
    one = mask.select("article_qid").withColumn("root", F.lit(0))
    return masked_trend(one.distinct() if distinct_articles else one, daily, start, end).select("date", "views")


def categories_top_articles(mask: DataFrame, daily: DataFrame, start: str, end: str, per_root: int = 50, n: int = 10) -> DataFrame:
    """(article_qid, views): the n articles with the most views, summed over the ``per_root`` first of each root."""
    each = top_articles(mask, daily, start, end, per_root)
    return each.groupBy("article_qid").agg(F.sum("views").alias("views")).orderBy(F.desc("views"), "article_qid").limit(n)


def category_articles_series(mask: DataFrame, daily: DataFrame, start: str, end: str) -> DataFrame:
    """(root, article_qid, total_views, series): members with their days of views in order, the most viewed first."""
    found = in_range(daily, start, end).join(mask, "article_qid")
    lists = found.groupBy("root", "article_qid").agg(F.sum("views").alias("total_views"), F.array_sort(F.collect_list(F.struct("date", "views"))).alias("series"))
    full = mask.join(lists, ["root", "article_qid"], "left").select(
        "root", "article_qid", F.coalesce("total_views", F.lit(0)).alias("total_views"),
        F.coalesce("series", F.array().cast("array<struct<date:date,views:bigint>>")).alias("series"),
    )
    return full.orderBy("root", F.desc("total_views"), "article_qid")


def trending_articles(nested: DataFrame) -> DataFrame:
    """(article_qid, views, categories): each article of a nested ranking once, with the categories it is in, most viewed first."""
    flat = unnested(nested)
    found = flat.groupBy("article_qid").agg(F.max("article_views").alias("views"), F.array_sort(F.collect_set("category_qid")).alias("categories"))
    return found.orderBy(F.desc("views"), "article_qid")


def overlay_series(series: DataFrame, labels: list[str]) -> DataFrame:
    """(date, one column a label) of rows (label, date, views), aligned by date; 0 where a series has no such day."""
    return series.groupBy("date").pivot("label", labels).agg(F.sum("views")).na.fill(0, labels).orderBy("date")


def global_views(daily: DataFrame, start: str, end: str) -> DataFrame:
    """(article_qid, views) over all editions."""
    return totals(daily, start, end)


def dataset_stats(daily: DataFrame, articles: DataFrame, categories: DataFrame) -> DataFrame:
    """(wiki, articles, categories, days, latest_date, views) of each edition."""
    seen = daily.groupBy("wiki").agg(F.countDistinct("date").alias("days"), F.max("date").alias("latest_date"), F.sum("views").alias("views"))
    a = articles.groupBy("wiki").agg(F.countDistinct("qid").alias("articles"))
    c = categories.groupBy("wiki").agg(F.countDistinct("qid").alias("categories"))
    return a.join(c, "wiki", "full").join(seen, "wiki", "full").select("wiki", "articles", "categories", "days", "latest_date", "views")


def category_rollup_totals(categories: DataFrame, edges: DataFrame, pairs: DataFrame, daily: DataFrame, depth: int, start: str, end: str) -> DataFrame:
    """(root, total_views) of every category with what is below it to ``depth``, each article once; none where no article has views.

    An article's totals meet the blocks of roots above it, and are summed root by root within a block's row.
    """
    found, bits = article_bits(categories.select(F.col("qid").alias("root")), edges, pairs.select(F.col("category_qid").alias("node"), "article_qid"), depth)
    return found.totals(totals(daily, start, end).join(bits, "article_qid"), F.col("views"), "total_views")
