"""Titles and ids of the dimensions. Requests are frames, answers only hold what was found unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import q_label


def titles(dimension: DataFrame) -> DataFrame:
    """(qid, title), one row a qid: the title of its smallest page_id."""
    return dimension.groupBy("qid").agg(F.min_by("page_title", "page_id").alias("title"))


def with_title(table: DataFrame, dimension: DataFrame, qid: str, name: str = "title") -> DataFrame:
    """Adds the title of a qid column, 'Q<id>' where it has none."""
    named = titles(dimension).select(F.col("qid").alias(qid), F.col("title").alias(name))
    return table.join(named, qid, "left").withColumn(name, F.coalesce(name, q_label(F.col(qid))))


def with_known_title(table: DataFrame, dimension: DataFrame, qid: str, name: str = "title") -> DataFrame:
    """Adds the title of a qid column and drops rows without one."""
    return table.join(titles(dimension).select(F.col("qid").alias(qid), F.col("title").alias(name)), qid)


def qids_by_titles(asked: DataFrame, dimension: DataFrame) -> DataFrame:
    """(page_title, qid) of the asked titles; of several pages with a title, that of the smallest page_id."""
    found = dimension.join(asked.select("page_title").distinct(), "page_title", "left_semi")
    return found.groupBy("page_title").agg(F.min_by("qid", "page_id").alias("qid"))


def page_ids_by_titles(asked: DataFrame, dimension: DataFrame) -> DataFrame:
    """(page_title, page_id) of the asked titles."""
    found = dimension.join(asked.select("page_title").distinct(), "page_title", "left_semi")
    return found.groupBy("page_title").agg(F.min("page_id").alias("page_id"))


def titles_by_qids(asked: DataFrame, *dimensions: DataFrame) -> DataFrame:
    """(qid, title) of the asked qids over all namespaces given."""
    rows = dimensions[0]
    for other in dimensions[1:]:
        rows = rows.unionByName(other)
    return titles(rows.join(asked.select("qid").distinct(), "qid", "left_semi"))


def translate_titles(asked: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(page_title, qid, translated): titles of one edition in another, by qid."""
    return qids_by_titles(asked, source).join(titles(target), "qid").select("page_title", "qid", F.col("title").alias("translated"))


def sub_categories_titled(parents: DataFrame, edges: DataFrame, categories: DataFrame) -> DataFrame:
    """(parent_qid, qid, title) of direct children that have a title, each once."""
    children = edges.join(parents.select("parent_qid").distinct(), "parent_qid", "left_semi").select("parent_qid", F.col("child_qid").alias("qid")).distinct()
    return with_known_title(children, categories, "qid").select("parent_qid", "qid", "title")


def title_map(table: DataFrame, by: str, qid: str = "qid", title: str = "title") -> DataFrame:
    """(by, titles): the map from qid to title of each group."""
    return table.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(qid, title)))).alias("titles"))
