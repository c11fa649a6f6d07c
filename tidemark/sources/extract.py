"""Dimensions and edges from the tables of a wiki's replica, given as DataFrames (Parquet exports or JDBC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import strip_q

ARTICLE, CATEGORY = 0, 14


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 16, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """A live replica table; with a numeric key and its bounds it is read in parallel ranges."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, numPartitions=parts, lowerBound=bounds[0], upperBound=bounds[1])
    return reader.load()


def _with_qid(pages: DataFrame, page_props: DataFrame) -> DataFrame:
    items = page_props.where("pp_propname = 'wikibase_item'").select(F.col("pp_page").alias("page_id"), strip_q(F.col("pp_value")).alias("qid"))
    return pages.join(items, "page_id").where("qid is not null").select("page_id", "qid", "page_title")


def extract_articles(page: DataFrame, page_props: DataFrame) -> DataFrame:
    """(page_id, qid, page_title) of articles that are neither redirects nor new."""
    articles = page.where(f"page_namespace = {ARTICLE} and page_is_redirect = 0 and page_is_new = 0")
    return _with_qid(articles, page_props)


def extract_categories(page: DataFrame, page_props: DataFrame) -> DataFrame:
    """(page_id, qid, page_title) of the categories that are not hidden."""
    hidden = page_props.where("pp_propname = 'hiddencat'").select(F.col("pp_page").alias("page_id"))
    shown = page.where(f"page_namespace = {CATEGORY}").join(hidden, "page_id", "left_anti")
    return _with_qid(shown, page_props)


def _links(kind: str, categorylinks: DataFrame, linktarget: DataFrame, page: DataFrame) -> DataFrame:
    """(child_page, parent_page): the members of kind ``kind`` and the pages of the categories that they name."""
    targets = linktarget.where(f"lt_namespace = {CATEGORY}").select("lt_id", F.col("lt_title").alias("page_title"))
    parents = page.where(f"page_namespace = {CATEGORY}").select(F.col("page_id").alias("parent_page"), "page_title")
    members = categorylinks.where(F.col("cl_type") == kind).select(F.col("cl_from").alias("child_page"), F.col("cl_target_id").alias("lt_id"))
    return members.join(targets, "lt_id").join(parents, "page_title").select("child_page", "parent_page")


def extract_category_graph(categorylinks: DataFrame, linktarget: DataFrame, page: DataFrame, categories: DataFrame) -> DataFrame:
    """(parent_qid, child_qid) of sub-category links whose both ends are in ``categories``."""
    child = categories.select(F.col("page_id").alias("child_page"), F.col("qid").alias("child_qid"))
    parent = categories.select(F.col("page_id").alias("parent_page"), F.col("qid").alias("parent_qid"))
    links = _links("subcat", categorylinks, linktarget, page)
    return links.join(child, "child_page").join(parent, "parent_page").select("parent_qid", "child_qid")


def extract_article_category(categorylinks: DataFrame, linktarget: DataFrame, page: DataFrame, articles: DataFrame, categories: DataFrame) -> DataFrame:
    """(article_qid, category_qid) of page links whose ends are in ``articles`` and ``categories``."""
    child = articles.select(F.col("page_id").alias("child_page"), F.col("qid").alias("article_qid"))
    parent = categories.select(F.col("page_id").alias("parent_page"), F.col("qid").alias("category_qid"))
    links = _links("page", categorylinks, linktarget, page)
    return links.join(child, "child_page").join(parent, "parent_page").select("article_qid", "category_qid")
