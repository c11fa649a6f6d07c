"""Scans and sinks of the engine's own Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources import schemas
from tidemark.sources.manifest import Manifest, new_generation


def for_wiki(table: DataFrame, wiki: str) -> DataFrame:
    """One edition's rows; on a partitioned table only its folders are read."""
    return table.where(F.col("wiki") == wiki)


def one_per_qid(dimension: DataFrame) -> DataFrame:
    """One row per edition and qid, that with the smallest page_id."""
    least = F.min(F.struct("page_id", "page_title")).alias("__row")
    return dimension.groupBy("wiki", "qid").agg(least).select("wiki", "__row.page_id", "qid", "__row.page_title")


def scan_dimension(spark: SparkSession, path: str) -> DataFrame:
    """Articles or categories without nulls, one row per edition and qid."""
    return one_per_qid(spark.read.schema(schemas.DIMENSION).parquet(path).dropna(subset=["page_id", "qid"]))


def known_edges(edges: DataFrame, categories: DataFrame) -> DataFrame:
    """Edges whose both ends are known categories; repeated edges stay."""
    parent = categories.select("wiki", F.col("qid").alias("parent_qid"))
    child = categories.select("wiki", F.col("qid").alias("child_qid"))
    return edges.dropna().join(parent, ["wiki", "parent_qid"], "left_semi").join(child, ["wiki", "child_qid"], "left_semi")


def known_pairs(pairs: DataFrame, articles: DataFrame, categories: DataFrame) -> DataFrame:
    """Distinct article-category pairs whose both ends are known."""
    article = articles.select("wiki", F.col("qid").alias("article_qid"))
    category = categories.select("wiki", F.col("qid").alias("category_qid"))
    kept = pairs.dropna().join(article, ["wiki", "article_qid"], "left_semi").join(category, ["wiki", "category_qid"], "left_semi")
    return kept.distinct()


def scan_category_edges(spark: SparkSession, path: str, categories: DataFrame) -> DataFrame:
    return known_edges(spark.read.schema(schemas.CATEGORY_GRAPH).parquet(path), categories)


def scan_article_category(spark: SparkSession, path: str, articles: DataFrame, categories: DataFrame) -> DataFrame:
    return known_pairs(spark.read.schema(schemas.ARTICLE_CATEGORY).parquet(path), articles, categories)


def scan_vectors_source(spark: SparkSession, path: str) -> DataFrame:
    """What is embedded of the categories: qid and title only."""
    return spark.read.schema(schemas.DIMENSION).parquet(path).select("wiki", "qid", "page_title")


def _write(table: DataFrame, path: str, parts: list[str]) -> None:
    """Overwrites just the partitions that the table has rows of."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_pageviews(table: DataFrame, path: str) -> None:
    _write(table.select("wiki", "page_id", "access_method", "daily_views", "date").repartition("date"), path, ["date"])


def write_dimension(table: DataFrame, path: str) -> None:
    """Any table of an edition: articles, categories, edges or pairs."""
    _write(table, path, ["wiki"])


def merge_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new vectors, the highest version of each qid; of equal versions the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = Window.partitionBy("wiki", "qid").orderBy(F.desc("version"), F.desc("__new"), "page_title")
    return both.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__new")


VECTOR_BUCKETS = 256
VECTOR_PARTS = ["wiki", "of", "bucket"]


def upsert_vectors(spark: SparkSession, path: str, new: DataFrame, buckets: int = VECTOR_BUCKETS) -> DataFrame:
    """Adds a batch to the vectors at ``path`` and returns all of them; the folder is made on first use.

    Vectors lie in hash buckets of their qid. Only the buckets that the batch has rows of are read, merged and written, and one
    commit of the manifest puts them in place of the old ones, so a batch costs what it touches. The number of buckets is that of the first batch.
    """
    state = Manifest.latest(spark, path)
    first = state.rows.where("kind = 'vectors'").limit(1).select(F.regexp_extract("part", "of=([0-9]+)", 1).cast("int")).collect()
    of = first[0][0] if first else buckets
    bucketed = new.withColumns({"of": F.lit(of), "bucket": F.pmod(F.xxhash64("qid"), F.lit(of)).cast("int")})
    touched = [f"wiki={r['wiki']}/of={of}/bucket={r['bucket']}" for r in bucketed.select("wiki", "bucket").distinct().collect()]  # bounded by editions x buckets
    schema = f"{schemas.CATEGORY_VECTORS}, of int, bucket int"
    old = state.scan("vectors", schema, F.col("part").isin(touched), F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in VECTOR_PARTS]).isin(touched))
    state.write("vectors", merge_vectors(old.select(*bucketed.columns), bucketed), VECTOR_PARTS, new_generation()).commit()
    return scan_vectors(spark, path)


def scan_vectors(spark: SparkSession, path: str) -> DataFrame:
    """All vectors, of each qid its newest version."""
    return Manifest.latest(spark, path).scan("vectors", f"{schemas.CATEGORY_VECTORS}, of int, bucket int").drop("of", "bucket")
