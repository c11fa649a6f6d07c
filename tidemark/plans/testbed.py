"""The engine's tables derived from the driver's tables, and the same in SQL for the oracles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.sources import dumps, tables


@dataclass
class Testbed:
    """Lazily derived tables of one folder."""

    spark: SparkSession
    sf_dir: str
    wiki: str = "enwiki"

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def articles(self) -> DataFrame:
        part = self.base("part").select(F.col("p_partkey").alias("qid"), F.concat_ws("_", F.translate("p_name", " ", "_"), F.col("p_partkey").cast("string")).alias("t"))
        return _editions(part, "qid", "t", 1000000, 1500000, F.col("qid") % 2 == 0)

    @cached_property
    def categories(self) -> DataFrame:
        supplier = self.base("supplier").select(F.col("s_suppkey").alias("qid"), F.translate("s_name", "#", "_").alias("t"))
        return _editions(supplier, "qid", "t", 2000000, 2500000, F.col("qid") % 3 != 0)

    @cached_property
    def graph(self) -> DataFrame:
        supplier = self.base("supplier")
        n = supplier.agg(F.count("*").alias("n"))
        pairs = supplier.join(F.broadcast(n)).select("s_suppkey", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
        return pairs.select(F.col("s_suppkey").alias("parent_qid"), ((2 * F.col("s_suppkey") + F.col("k")) % F.col("n")).alias("child_qid"))

    @cached_property
    def article_category(self) -> DataFrame:
        first = self.base("lineitem").where("l_linenumber = 1")
        return first.select(F.col("l_partkey").alias("article_qid"), F.col("l_suppkey").alias("category_qid")).distinct()

    @cached_property
    def dump(self) -> DataFrame:
        """Parsed dump lines, before any normalisation."""
        french = F.col("l_orderkey") % 4 == 0
        return self.base("lineitem").select(
            F.when(french, "fr.wikipedia").otherwise("en.wikipedia").alias("domain"),
            F.when(french, F.col("l_partkey") + 1500000).otherwise(F.col("l_partkey") + 1000000).alias("page_id"),
            F.when(F.col("l_returnflag") == "A", "desktop").when(F.col("l_returnflag") == "N", "mobile-web").otherwise("mobile-app").alias("access_method"),
            F.col("l_quantity").cast("bigint").alias("daily_views"), F.col("l_shipdate").cast("date").alias("date"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Dump lines as text, some of them bad."""
        table = self.dump.select("domain", F.lit("Title").alias("t"), "page_id", "access_method", "daily_views", "date")
        good = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("domain", "t", "page_id", "access_method", "daily_views")], F.lit("A1 B2"))
        bad = F.when(F.col("page_id") % 10 == 3, F.concat(F.lit("x "), good)).when(F.col("page_id") % 10 == 7, "too short").otherwise(good)
        return table.select(bad.alias("value"), "date")

    @cached_property
    def pageviews(self) -> DataFrame:
        return dumps.normalize_pageviews(self.dump)

    @cached_property
    def all_daily(self) -> DataFrame:
        return ingest.daily_article_views(self.pageviews, self.articles)

    @cached_property
    def daily(self) -> DataFrame:
        return tables.for_wiki(self.all_daily, self.wiki)

    @cached_property
    def own_articles(self) -> DataFrame:
        return tables.for_wiki(self.articles, self.wiki)

    @cached_property
    def own_categories(self) -> DataFrame:
        return tables.for_wiki(self.categories, self.wiki)

    @cached_property
    def edges(self) -> DataFrame:
        return tables.known_edges(self.graph.withColumn("wiki", F.lit(self.wiki)), self.own_categories)

    @cached_property
    def pairs(self) -> DataFrame:
        pairs = self.article_category.withColumn("wiki", F.lit(self.wiki))
        return tables.known_pairs(pairs, self.own_articles, self.own_categories).drop("wiki")

    @cached_property
    def vectors(self) -> DataFrame:
        named = F.concat(F.lit("cat_"), F.col("vec_id").cast("string"))
        return self.base("embeddings").select(F.col("vec_id").alias("qid"), named.alias("page_title"), "embedding")

    @cached_property
    def queries(self) -> DataFrame:
        """Search requests: every twentieth vector."""
        return self.vectors.where("qid % 20 = 0").select(F.col("qid").alias("query_id"), "embedding")

    @cached_property
    def page(self) -> DataFrame:
        articles = tables.for_wiki(self.articles, "enwiki").select(
            _replica_id("page_id", 0).alias("page_id"), F.lit(0).alias("page_namespace"), "page_title",
            (F.col("qid") % 11 == 0).cast("int").alias("page_is_redirect"), (F.col("qid") % 13 == 0).cast("int").alias("page_is_new"),
        )
        rest = [
            tables.for_wiki(self.categories, "enwiki").select(_replica_id("page_id", 1), F.lit(14), "page_title", F.lit(0), F.lit(0)),
            self.base("nation").select(_replica_id(F.col("n_nationkey").cast("bigint") + 3000000, 2), F.lit(1), "n_name", F.lit(0), F.lit(0)),
        ]
        return articles.union(rest[0]).union(rest[1])

    @cached_property
    def page_props(self) -> DataFrame:
        label = F.concat(F.lit("Q"), F.col("qid").cast("string"))
        articles = tables.for_wiki(self.articles, "enwiki").where("qid % 17 <> 0")
        categories = tables.for_wiki(self.categories, "enwiki")
        items = [
            t.select(_replica_id("page_id", kind).alias("pp_page"), F.lit("wikibase_item").alias("pp_propname"), label.alias("pp_value"))
            for kind, t in enumerate((articles, categories))
        ]
        return items[0].union(items[1]).union(categories.where("qid % 9 = 0").select(_replica_id("page_id", 1), F.lit("hiddencat"), F.lit("")))

    @cached_property
    def linktarget(self) -> DataFrame:
        categories = tables.for_wiki(self.categories, "enwiki").select(_replica_id("qid", 1).alias("lt_id"), F.lit(14).alias("lt_namespace"), F.col("page_title").alias("lt_title"))
        return categories.union(tables.for_wiki(self.articles, "enwiki").select(_replica_id("qid", 0), F.lit(0), "page_title"))

    @cached_property
    def categorylinks(self) -> DataFrame:
        line = self.base("lineitem")
        kind = F.when(F.col("l_linenumber") == 1, "page").otherwise("file").alias("cl_type")
        members = line.where("l_linenumber <= 2").select(
            _replica_id(F.col("l_partkey") + 1000000, 0).alias("cl_from"), _replica_id("l_suppkey", 1).alias("cl_target_id"), kind
        )
        below = self.graph.select(_replica_id(F.col("child_qid") + 2000000, 1), _replica_id("parent_qid", 1), F.lit("subcat"))
        return members.distinct().union(below)


def _replica_id(number: Column | str, kind: int) -> Column:
    """A replica's id, which no other kind (0 article, 1 category, 2 other) has, however many there are of each."""
    return (F.col(number) if isinstance(number, str) else number) * 4 + kind


def own_page_id(page_id: Column) -> Column:
    """The page_id of articles and categories that a replica's id was made of."""
    return F.shiftright(page_id, 2)


def _editions(table: DataFrame, qid: str, title: str, english: int, french: int, in_french: Column) -> DataFrame:
    first = table.select(F.lit("enwiki").alias("wiki"), (F.col(qid) + english).alias("page_id"), qid, F.col(title).alias("page_title"))
    second = table.where(in_french).select(F.lit("frwiki"), F.col(qid) + french, qid, F.concat(F.lit("fr_"), F.col(title)))
    return first.union(second)
