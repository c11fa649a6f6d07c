"""What changed between two periods, for categories and for the articles of a category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import delta_percentage
from tidemark.functions.lineage import cut
from tidemark.operators.graph import articles_in_category
from tidemark.operators.views import few

Period = tuple[str, str]


def _within(period: Period) -> Column:
    return F.when(F.col("date").between(F.lit(period[0]).cast("date"), F.lit(period[1]).cast("date")), F.col("views")).otherwise(0)


def period_totals(daily: DataFrame, baseline: Period, impact: Period) -> DataFrame:
    """(article_qid, baseline_views, impact_views): both periods in one scan that reads no other days."""
    spans = [F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in (baseline, impact)]
    return daily.where(spans[0] | spans[1]).groupBy("article_qid").agg(
        F.sum(_within(baseline)).alias("baseline_views"), F.sum(_within(impact)).alias("impact_views")
    )


def _in_top(side: str, key: str, by: list[str], limit: int) -> Column:
    order = Window.partitionBy(*by).orderBy(F.desc(side), key)
    return (F.row_number().over(order) <= limit) & (F.col(side) > 0)


def _changes(table: DataFrame, key: str) -> DataFrame:
    """Adds the percentage and the signed difference, the largest difference first."""
    change = F.col("impact_views") - F.col("baseline_views")
    full = table.withColumn("delta_percentage", delta_percentage(F.col("baseline_views"), F.col("impact_views"))).withColumn("absolute_delta", change)
    return full.orderBy(F.desc(F.abs("absolute_delta")), key)


def category_delta(
    categories: DataFrame, edges: DataFrame, pairs: DataFrame, daily: DataFrame, baseline: Period, impact: Period,
    limit: int = 100, depth: int = 0, mode: str = "consistent",
) -> DataFrame:
    """(qid, baseline_views, impact_views, delta_percentage, absolute_delta) of the categories in either period's top ``limit``.

    The tops are by direct members. In mode ``consistent`` both sides count members to ``depth``; in mode ``reference``
    a side whose period has the category in its top stays direct and only the other is counted to ``depth``. The views are
    read once: what is used again, a row for each article and one for each category, is kept in the checkpoint folder.
    """
    by_article = period_totals(daily, baseline, impact)
    by_article = by_article if depth == 0 else cut(by_article)
    direct = cut(by_article.join(pairs, "article_qid").groupBy(F.col("category_qid").alias("qid")).agg(
        F.sum("baseline_views").alias("baseline_views"), F.sum("impact_views").alias("impact_views")
    ))
    # One top-k over all rows is a sort with a limit; a window over everything would go to one task.
    tops = [
        direct.where(F.col(side) > 0).orderBy(F.desc(side), "qid").limit(limit).select("qid", F.lit(True).alias(f"in_{side}"))
        for side in ("baseline_views", "impact_views")
    ]
    both = tops[0].join(tops[1], "qid", "full")
    chosen = direct.join(few(both, 2 * limit), "qid")
    if depth == 0:
        return _changes(chosen.select("qid", "baseline_views", "impact_views"), "qid")
    mask = articles_in_category(both.select(F.col("qid").alias("root")), categories, edges, pairs, depth)
    deep = by_article.join(mask, "article_qid").groupBy(F.col("root").alias("qid")).agg(
        F.sum("baseline_views").alias("deep_baseline_views"), F.sum("impact_views").alias("deep_impact_views")
    )
    met = chosen.join(deep, "qid", "left")
    sides = []
    for side in ("baseline_views", "impact_views"):
        below = F.coalesce(f"deep_{side}", F.lit(0))
        sides.append((F.when(F.col(f"in_{side}"), F.col(side)).otherwise(below) if mode == "reference" else below).alias(side))
    return _changes(met.select("qid", *sides), "qid")


def article_delta(
    roots: DataFrame, categories: DataFrame, edges: DataFrame, pairs: DataFrame, daily: DataFrame, baseline: Period, impact: Period,
    limit: int = 100, depth: int = 0,
) -> DataFrame:
    """The same over the articles of each root to ``depth``: (root, qid, ...) of those in either period's top ``limit``."""
    mask = articles_in_category(roots, categories, edges, pairs, depth)
    found = period_totals(daily, baseline, impact).join(mask, "article_qid").withColumnRenamed("article_qid", "qid")
    kept = found.withColumn("b", _in_top("baseline_views", "qid", ["root"], limit)).withColumn("i", _in_top("impact_views", "qid", ["root"], limit))
    return _changes(kept.where("b or i").select("root", "qid", "baseline_views", "impact_views"), "qid")
