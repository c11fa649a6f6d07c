"""All registered queries of the engine. Their SQL is in ``tidemark.plans.oracle`` under the same names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns
from tidemark.functions.lineage import shared_folder
from tidemark.operators import delta, graph, nearest, titles, vectors, views, walk
from tidemark.operators import ingest as daily
from tidemark.plans import oracle
from tidemark.plans.testbed import Testbed, own_page_id
from tidemark.sources import daily as daily_table
from tidemark.sources import bucketed, dumps, extract, schemas, tables
from tidemark.streaming.daily import stream_daily_views as start_stream

START, END = "1998-01-01", "1998-01-31"
LONG, EARLIER = ("1995-12-20", "1997-01-15"), ("1995-03-01", "1996-02-10")
BASELINE, IMPACT = ("1998-01-01", "1998-01-31"), ("1998-02-01", "1998-02-28")
ROOT = 7
DUMP_FILES = 8
"""Files at most of a month's dump."""
N = 10

Query = Callable[[Testbed], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _roots(t: Testbed) -> DataFrame:
    return t.own_categories.select(F.col("qid").alias("root"))


def _one(t: Testbed, name: str, *values: object) -> DataFrame:
    return t.spark.createDataFrame([(v,) for v in values], f"{name} bigint" if isinstance(values[0], int) else f"{name} string")


def _mask(t: Testbed, roots: DataFrame, depth: int | None) -> DataFrame:
    return graph.articles_in_category(roots, t.own_categories, t.edges, t.pairs, depth)


# sources and ingest


@query
def read_pageview_dump(t: Testbed) -> DataFrame:
    return dumps.parse_dump_lines(t.lines, F.col("date"))


@query
def read_compressed_dump(t: Testbed) -> DataFrame:
    """All lines written as bzip2 files of a month's days, read back by the reader of dumps."""
    path = shared_folder(t.spark, "dumps")
    lines = t.lines.where("date is not null").select("value", F.date_format(F.last_day("date"), "yyyyMMdd").alias("day"))
    # Compressing takes the time, so a month's lines are dealt over many tasks and files.
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    lines.repartition(tasks, "day", F.pmod(F.xxhash64("value"), F.lit(DUMP_FILES))).write.partitionBy("day").option("compression", "bzip2").text(path)
    return dumps.read_pageview_dump(t.spark, path, file_day=r"day=([0-9]{8})/").withColumn("access_method", F.col("access_method").cast("int"))


@query
def normalize_pageviews(t: Testbed) -> DataFrame:
    return t.pageviews.withColumn("access_method", F.col("access_method").cast("int"))


@query
def daily_article_views(t: Testbed) -> DataFrame:
    return t.all_daily


@query
def backfill_days(t: Testbed) -> DataFrame:
    return daily.missing_days(t.spark, END, t.all_daily.where("day(date) % 5 <> 0"))


@query
def backfill_range(t: Testbed) -> DataFrame:
    """A month of which every fifth day was missing, after it was filled in."""
    path = shared_folder(t.spark, "backfill")
    daily_table.write_daily_views(views.in_range(t.all_daily, START, END).where("day(date) % 5 <> 0"), path)
    daily.backfill_range(t.spark, t.pageviews, t.articles, path, END)
    return daily_table.scan_daily_views(t.spark, path, START, END).select("wiki", "date", "article_qid", "views")


@query
def taken_days(t: Testbed) -> DataFrame:
    """Days taken in after a month was filled in of which nothing but the first edition's pageviews of even days exist."""
    path = shared_folder(t.spark, "taken")
    some = t.pageviews.where("wiki = 'enwiki' and day(date) % 2 = 0")
    daily_table.write_daily_views(daily.daily_article_views(views.in_range(some, *IMPACT), t.articles), path)
    daily.backfill_range(t.spark, some, t.articles, path, END)
    return daily_table.taken_days(t.spark, path)


@query
def write_pageviews(t: Testbed) -> DataFrame:
    path = shared_folder(t.spark, "pageviews")
    tables.write_pageviews(t.pageviews, path)
    found = t.spark.read.schema(schemas.PAGEVIEWS_RAW).parquet(path)
    return found.withColumn("access_method", F.col("access_method").cast("int"))


def _written_views(t: Testbed, start: str, end: str) -> str:
    """The path of a new table of the daily views of all whole months that a range touches, and of a month on both sides."""
    path, first, last = shared_folder(t.spark, "views"), F.add_months(F.trunc(F.lit(start), "month"), -1), F.add_months(F.last_day(F.lit(end)), 1)
    daily_table.write_daily_views(t.all_daily.where(F.col("date").between(first, last)), path)
    return path


@query
def write_daily_views(t: Testbed) -> DataFrame:
    path = shared_folder(t.spark, "views")
    daily_table.write_daily_views(t.all_daily, path)
    return daily_table.all_daily_views(t.spark, path).select("wiki", "date", "article_qid", "views")


@query
def scan_daily_views(t: Testbed) -> DataFrame:
    """Totals of a range from the written table, of which only the folders of that edition and those days are read."""
    return views.totals(tables.for_wiki(daily_table.scan_daily_views(t.spark, _written_views(t, START, END), START, END), t.wiki), START, END)


@query
def global_views_by_months(t: Testbed) -> DataFrame:
    """Totals of a long range from the written table: month sums, and days at its edges."""
    return views.global_views(daily_table.scan_range_views(t.spark, _written_views(t, *LONG), LONG), *LONG)


@query
def top_categories_by_months(t: Testbed) -> DataFrame:
    found = daily_table.scan_range_views(t.spark, _written_views(t, *LONG), LONG)
    return views.top_categories(tables.for_wiki(found, t.wiki), t.pairs, *LONG, N)


@query
def category_delta_by_months(t: Testbed) -> DataFrame:
    """Two overlapping ranges of some months, summed from months where both have them whole or not at all."""
    found = tables.for_wiki(daily_table.scan_range_views(t.spark, _written_views(t, EARLIER[0], LONG[1]), EARLIER, LONG), t.wiki)
    return _rounded(delta.category_delta(t.own_categories, t.edges, t.pairs, found, EARLIER, LONG, 20, 1))


@query
def write_dimension(t: Testbed) -> DataFrame:
    path = shared_folder(t.spark, "articles")
    tables.write_dimension(t.articles, path)
    return tables.scan_dimension(t.spark, path)


@query
def scan_vectors_source(t: Testbed) -> DataFrame:
    path = shared_folder(t.spark, "categories")
    tables.write_dimension(t.categories, path)
    return tables.scan_vectors_source(t.spark, path)


@query
def stream_daily_views(t: Testbed) -> DataFrame:
    """Dump files of all days, a folder for each, taken in by the stream in three batches and in no order."""
    path = shared_folder(t.spark, "stream")
    lines = t.lines.select("value", F.date_format("date", "yyyyMMdd").alias("day"))
    lines.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "day").write.partitionBy("day").text(f"{path}/dumps")
    days = lines.select("day").distinct().count()
    query = start_stream(
        t.spark, f"{path}/dumps", t.articles, f"{path}/views", f"{path}/state", r"day=([0-9]{8})/", late="40000 days", files_at_once=-(-days // 3), by_name=False
    )
    query.awaitTermination()
    return daily_table.all_daily_views(t.spark, f"{path}/views").select("wiki", "date", "article_qid", "views")


@query
def parse_replica_tsv(t: Testbed) -> DataFrame:
    number = F.col("page_id").cast("string")
    qid = F.when(F.col("page_id") % 10 == 3, "NULL").otherwise(F.col("qid").cast("string"))
    line = F.when(F.col("page_id") % 10 == 7, F.concat_ws("\t", number, qid)).otherwise(F.concat_ws("\t", number, qid, "page_title", F.lit("more")))
    return dumps.parse_replica_tsv(t.articles.select(line.alias("value")), ["page_id", "qid", "page_title"], {"page_id", "qid"})


@query
def wiki_editions(t: Testbed) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    name = F.when(key % 5 == 0, F.concat(F.lit("#c"), key, F.lit("wiki"))).when(key % 5 == 1, F.concat(F.lit("testc"), key, F.lit("wiki")))
    names = t.base("customer").select("c_custkey", name.when(key % 5 == 2, F.concat(F.lit("c"), key, F.lit("wikibooks"))).otherwise(F.concat(F.lit("c"), key, F.lit("wiki"))).alias("value"))
    return dumps.wiki_editions(names, names.where("c_custkey % 7 = 0"))


@query
def site_matrix_editions(t: Testbed) -> DataFrame:
    """Matrix documents of a hundred languages each."""
    key = F.col("c_custkey").cast("string")
    site = F.struct(
        F.lit("wiki").alias("code"), F.concat(F.lit("https://"), key).alias("url"), F.concat(F.lit("c"), key, F.lit("wiki")).alias("dbname"),
        F.when(F.col("c_custkey") % 3 == 0, "").alias("closed"), F.when(F.col("c_custkey") % 5 == 0, "").alias("private"),
    )
    other = F.struct(F.lit("wiktionary").alias("code"), site["url"].alias("url"), site["dbname"].alias("dbname"), F.lit(None).cast("string").alias("closed"), F.lit(None).cast("string").alias("private"))
    language = F.struct(F.concat(F.lit("c"), key).alias("code"), F.col("c_name").alias("name"), F.array(other, site).alias("site"))
    entries = t.base("customer").groupBy(F.floor(F.col("c_custkey") / 100)).agg(F.collect_list(F.struct(key, language)).alias("e"))
    return dumps.site_matrix_editions(entries.select(F.to_json(F.struct(F.map_from_entries("e").alias("sitematrix"))).alias("value")))


@query
def column_functions(t: Testbed) -> DataFrame:
    title = F.concat(F.lit("Category: "), columns.to_spaces(F.col("page_title")))
    return t.categories.select(
        "wiki", "qid", title.alias("title"), columns.to_underscores(title).alias("underscored"), columns.strip_namespace(title).alias("bare"),
        columns.strip_q(columns.q_label(F.col("qid"))).alias("number"),
        columns.period_label(F.lit(START).cast("date"), F.lit(END).cast("date")).alias("period"), columns.lossy_text(F.encode("page_title", "UTF-8")).alias("decoded"),
    )


@query
def extract_articles(t: Testbed) -> DataFrame:
    return extract.extract_articles(t.page, t.page_props).withColumn("page_id", own_page_id(F.col("page_id")))


@query
def extract_categories(t: Testbed) -> DataFrame:
    return extract.extract_categories(t.page, t.page_props).withColumn("page_id", own_page_id(F.col("page_id")))


@query
def extract_category_graph(t: Testbed) -> DataFrame:
    return extract.extract_category_graph(t.categorylinks, t.linktarget, t.page, extract.extract_categories(t.page, t.page_props))


@query
def extract_article_category(t: Testbed) -> DataFrame:
    articles, categories = extract.extract_articles(t.page, t.page_props), extract.extract_categories(t.page, t.page_props)
    return extract.extract_article_category(t.categorylinks, t.linktarget, t.page, articles, categories)


@query
def referential_integrity(t: Testbed) -> DataFrame:
    pairs = t.article_category.withColumn("wiki", F.lit("frwiki"))
    return tables.known_pairs(pairs, tables.for_wiki(t.articles, "frwiki"), tables.for_wiki(t.categories, "frwiki"))


@query
def scan_category_edges(t: Testbed) -> DataFrame:
    return tables.known_edges(t.graph.withColumn("wiki", F.lit("frwiki")), tables.for_wiki(t.categories, "frwiki"))


@query
def scan_dimension(t: Testbed) -> DataFrame:
    return tables.one_per_qid(t.articles.unionByName(t.articles.withColumn("page_id", F.col("page_id") + 1)))


# graph


@query
def child_categories(t: Testbed) -> DataFrame:
    return graph.child_categories(t.own_categories.select(F.col("qid").alias("parent_qid")), t.edges)


@query
def parent_categories(t: Testbed) -> DataFrame:
    return graph.parent_categories(t.own_categories.select(F.col("qid").alias("child_qid")), t.edges)


@query
def article_categories(t: Testbed) -> DataFrame:
    return graph.article_categories(t.own_articles.select(F.col("qid").alias("article_qid")), t.pairs)


@query
def category_exists(t: Testbed) -> DataFrame:
    return graph.exists(t.categories.select("qid"), tables.for_wiki(t.categories, "frwiki"))


@query
def article_exists(t: Testbed) -> DataFrame:
    return graph.exists(t.articles.select("qid"), tables.for_wiki(t.articles, "frwiki"))


@query
def sub_category_counts(t: Testbed) -> DataFrame:
    return graph.sub_category_counts(t.edges.select("parent_qid", "child_qid"))


@query
def sub_categories_counted(t: Testbed) -> DataFrame:
    asked = t.own_categories.select(F.col("qid").alias("parent_qid"))
    return graph.sub_categories_counted(asked, t.edges, tables.for_wiki(t.categories, "frwiki"))


@query
def descendant_categories(t: Testbed) -> DataFrame:
    return graph.descendant_categories(_roots(t), t.own_categories, t.edges, 3).withColumn("depth", F.col("depth").cast("bigint"))


@query
def articles_in_category(t: Testbed) -> DataFrame:
    return _mask(t, _roots(t), 2)


@query
def articles_in_category_unlimited(t: Testbed) -> DataFrame:
    return _mask(t, _roots(t), None)


@query
def category_components(t: Testbed) -> DataFrame:
    return walk.components(t.edges)


@query
def category_depth_stats(t: Testbed) -> DataFrame:
    return graph.category_depth_stats(_roots(t), t.own_categories, t.edges).select(
        "root", F.col("max_depth").cast("bigint").alias("max_depth"), F.round("average_depth", 6).alias("average_depth"), "reached", "unreachable"
    )


@query
def depth_histogram(t: Testbed) -> DataFrame:
    return graph.depth_histogram(_roots(t), t.own_categories, t.edges).withColumn("depth", F.col("depth").cast("bigint"))


# trends and rankings


@query
def top_categories(t: Testbed) -> DataFrame:
    return views.top_categories(t.daily, t.pairs, START, END, N)


@query
def top_categories_nested(t: Testbed) -> DataFrame:
    flat = views.unnested(views.top_categories_nested(t.daily, t.pairs, START, END, N))
    return flat.withColumn("rank", F.col("rank").cast("bigint"))


@query
def top_categories_titled(t: Testbed) -> DataFrame:
    flat = top_categories_nested(t)
    named = titles.with_title(flat, t.own_categories, "category_qid", "category_title")
    return titles.with_title(named, tables.for_wiki(t.articles, "frwiki"), "article_qid", "article_title")


@query
def ranked_categories(t: Testbed) -> DataFrame:
    ranked = views.ranked_categories(t.daily, t.pairs, START, END, N)
    return ranked.withColumn("rank", F.col("rank").cast("bigint")).withColumn("daily_average", F.round("daily_average", 6))


@query
def category_trend(t: Testbed) -> DataFrame:
    return views.category_trend(_roots(t), t.own_categories, t.edges, t.pairs, t.daily, 2, START, END)


@query
def category_trend_direct(t: Testbed) -> DataFrame:
    return views.category_trend(_roots(t), t.own_categories, t.edges, t.pairs, t.daily, 0, START, END)


@query
def article_trend(t: Testbed) -> DataFrame:
    return views.article_trend(t.own_articles.select(F.col("qid").alias("article_qid")), t.own_articles, t.daily, START, END)


@query
def article_trend_by_title(t: Testbed) -> DataFrame:
    asked = titles.qids_by_titles(t.own_articles.select("page_title"), t.own_articles)
    found = views.article_trend(asked.select(F.col("qid").alias("article_qid")), t.own_articles, t.daily, START, END)
    return found.join(asked, found["article_qid"] == asked["qid"]).select("page_title", "article_qid", "date", "views")


@query
def top_articles_in_category(t: Testbed) -> DataFrame:
    found = views.top_articles_in_category(_roots(t), t.own_categories, t.edges, t.pairs, t.daily, 1, START, END, N)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


@query
def category_trend_with_top(t: Testbed) -> DataFrame:
    asked = titles.qids_by_titles(t.own_categories.select("page_title"), t.own_categories).select(F.col("qid").alias("root"))
    mask = _mask(t, asked, 1)
    trend = views.masked_trend(mask, t.daily, START, END).select("root", F.lit("trend").alias("part"), F.col("date").cast("string").alias("item"), "views")
    top = titles.with_title(views.top_articles(mask, t.daily, START, END, N), t.own_articles, "article_qid")
    return trend.unionByName(top.select("root", F.lit("top").alias("part"), F.col("title").alias("item"), "views"))


@query
def categories_trend(t: Testbed) -> DataFrame:
    return views.categories_trend(_mask(t, _roots(t), 1), t.daily, START, END)


@query
def categories_trend_distinct(t: Testbed) -> DataFrame:
    return views.categories_trend(_mask(t, _roots(t), 1), t.daily, START, END, distinct_articles=True)


@query
def categories_trend_top_articles(t: Testbed) -> DataFrame:
    top = views.categories_top_articles(_mask(t, _roots(t), 1), t.daily, START, END, 50, N)
    return titles.with_title(top, t.own_articles, "article_qid")


@query
def sub_categories_titled(t: Testbed) -> DataFrame:
    return titles.sub_categories_titled(t.own_categories.select(F.col("qid").alias("parent_qid")), t.edges, tables.for_wiki(t.categories, "frwiki"))


@query
def category_articles_titled(t: Testbed) -> DataFrame:
    return titles.with_title(_mask(t, _roots(t), 0), tables.for_wiki(t.articles, "frwiki"), "article_qid")


@query
def category_articles_series(t: Testbed) -> DataFrame:
    found = views.category_articles_series(_mask(t, _roots(t), 0), t.daily, START, END)
    return found.select("root", "article_qid", "total_views", F.explode_outer("series").alias("s")).select("root", "article_qid", "total_views", "s.date", "s.views")


@query
def category_delta(t: Testbed) -> DataFrame:
    return _rounded(delta.category_delta(t.own_categories, t.edges, t.pairs, t.daily, BASELINE, IMPACT, 20))


@query
def category_delta_deep(t: Testbed) -> DataFrame:
    return _rounded(delta.category_delta(t.own_categories, t.edges, t.pairs, t.daily, BASELINE, IMPACT, 20, 1))


@query
def category_delta_reference_mode(t: Testbed) -> DataFrame:
    return _rounded(delta.category_delta(t.own_categories, t.edges, t.pairs, t.daily, BASELINE, IMPACT, 20, 1, "reference"))


@query
def article_delta(t: Testbed) -> DataFrame:
    return _rounded(delta.article_delta(_roots(t), t.own_categories, t.edges, t.pairs, t.daily, BASELINE, IMPACT, 20, 1))


def _rounded(changes: DataFrame) -> DataFrame:
    return changes.withColumn("delta_percentage", F.round("delta_percentage", 6))


@query
def trending_articles(t: Testbed) -> DataFrame:
    found = views.trending_articles(views.top_categories_nested(t.daily, t.pairs, START, END, 50))
    return found.select("article_qid", "views", F.explode("categories").alias("category_qid"))


@query
def overlay_series(t: Testbed) -> DataFrame:
    trend = views.category_trend(_one(t, "root", ROOT, 3), t.own_categories, t.edges, t.pairs, t.daily, 1, START, END)
    labelled = trend.select(F.concat(F.lit("c"), F.col("root").cast("string")).alias("label"), "date", "views")
    return views.overlay_series(labelled, ["c3", f"c{ROOT}"])


@query
def global_views(t: Testbed) -> DataFrame:
    return views.global_views(t.all_daily, START, END)


@query
def dataset_stats(t: Testbed) -> DataFrame:
    return views.dataset_stats(t.all_daily, t.articles, t.categories)


@query
def category_rollup_totals(t: Testbed) -> DataFrame:
    return views.category_rollup_totals(t.own_categories, t.edges, t.pairs, t.daily, 2, START, END)


# titles


@query
def qids_by_titles(t: Testbed) -> DataFrame:
    return titles.qids_by_titles(t.articles.select("page_title"), t.own_articles)


@query
def qid_by_title(t: Testbed) -> DataFrame:
    return titles.qids_by_titles(t.own_categories.select("page_title"), t.own_categories)


@query
def page_id_by_title(t: Testbed) -> DataFrame:
    return titles.page_ids_by_titles(t.articles.select("page_title"), t.own_articles)


@query
def titles_by_qids(t: Testbed) -> DataFrame:
    return titles.titles_by_qids(t.articles.select("qid"), tables.for_wiki(t.articles, "frwiki"))


@query
def title_by_qid(t: Testbed) -> DataFrame:
    return titles.titles_by_qids(t.own_categories.select("qid"), t.own_categories)


@query
def translate_titles(t: Testbed) -> DataFrame:
    return titles.translate_titles(t.own_articles.select("page_title"), t.own_articles, tables.for_wiki(t.articles, "frwiki"))


def _bucketed(t: Testbed, table: DataFrame, key: str) -> DataFrame:
    return bucketed.read_bucketed(t.spark, bucketed.write_bucketed(table, shared_folder(t.spark, "bucketed"), key, 8))


@query
def titles_by_qids_bucketed(t: Testbed) -> DataFrame:
    """The asked qids go to the buckets of the dimension, which stays where it is."""
    return titles.titles_by_qids(t.articles.select("qid"), tables.for_wiki(_bucketed(t, t.articles, "qid"), "frwiki"))


@query
def translate_titles_bucketed(t: Testbed) -> DataFrame:
    return titles.translate_titles(t.own_articles.select("page_title"), t.own_articles, tables.for_wiki(_bucketed(t, t.articles, "qid"), "frwiki"))


@query
def top_categories_bucketed(t: Testbed) -> DataFrame:
    """Daily views and pairs in the same buckets: sums by article and their join move nothing."""
    return views.top_categories(_bucketed(t, t.daily, "article_qid"), _bucketed(t, t.pairs, "article_qid"), START, END, N)


@query
def title_map(t: Testbed) -> DataFrame:
    """The titled children of each category as a map, and the map's entries."""
    children = titles.sub_categories_titled(t.own_categories.select(F.col("qid").alias("parent_qid")), t.edges, tables.for_wiki(t.categories, "frwiki"))
    return titles.title_map(children, "parent_qid").select("parent_qid", F.explode("titles").alias("qid", "title"))


# vectors


def _toy_encoder() -> vectors.Encode:
    """Letter frequencies, to run the encoder hook without a model."""
    return lambda texts, prompt: [[float(((prompt or "") + text).lower().count(c)) for c in "aeinorst"] for text in texts]


def _numbers(embedded: DataFrame, *keys: str) -> DataFrame:
    """(keys, place, value): one row for each number of each vector."""
    return embedded.select(*keys, F.posexplode("embedding").alias("place", "value")).withColumns({"place": F.col("place").cast("bigint"), "value": F.col("value").cast("double")})


@query
def embed_categories(t: Testbed) -> DataFrame:
    return _numbers(vectors.embed_categories(t.categories, _toy_encoder), "wiki", "qid", "page_title", "version")


@query
def encode_texts(t: Testbed) -> DataFrame:
    return _numbers(vectors.encode_texts(t.articles.select("wiki", "page_id", "page_title"), "page_title", _toy_encoder, "title: "), "wiki", "page_id")


@query
def similarity_matrix(t: Testbed) -> DataFrame:
    return vectors.similarity_matrix(t.queries, t.vectors).withColumn("score", F.round("score", 6))


@query
def most_similar(t: Testbed) -> DataFrame:
    return vectors.most_similar(t.queries, t.vectors, N).withColumn("rank", F.col("rank").cast("bigint"))


@query
def most_similar_by_clusters(t: Testbed) -> DataFrame:
    """The same from an index, of which clusters are skipped that cannot hold a better vector."""
    index = nearest.build_index(t.vectors, shared_folder(t.spark, "index"), 32)
    return nearest.nearest(t.queries, index, N).withColumn("rank", F.col("rank").cast("bigint"))


@query
def vector_search(t: Testbed) -> DataFrame:
    return vectors.vector_search(t.queries, t.vectors, 50).withColumn("rank", F.col("rank").cast("bigint"))


@query
def search_categories(t: Testbed) -> DataFrame:
    return vectors.search_categories(t.queries, t.vectors, tables.for_wiki(t.categories, "frwiki"))


@query
def search_categories_own_titles(t: Testbed) -> DataFrame:
    return vectors.search_categories(t.queries, t.vectors)


@query
def search_categories_trend(t: Testbed) -> DataFrame:
    mask = vectors.search_mask(t.queries, t.vectors, t.own_categories, t.edges, t.pairs)
    return views.masked_trend(mask, t.daily, START, END)


@query
def category_trend_or_search(t: Testbed) -> DataFrame:
    title = F.when(F.col("query_id") % 40 == 0, F.concat(F.lit("Supplier_"), F.lpad((F.col("query_id") / 20 + 1).cast("int").cast("string"), 9, "0")))
    asked = t.queries.withColumn("page_title", F.coalesce(title, F.lit("no such title")))
    mask = vectors.trend_or_search_mask(asked, t.vectors, t.own_categories, t.edges, t.pairs, 2)
    return views.masked_trend(mask, t.daily, START, END)


@query
def upsert_vectors(t: Testbed) -> DataFrame:
    """Two batches into one folder, the second with other titles and vectors for a third of the qids."""
    path = shared_folder(t.spark, "vectors")
    first = t.vectors.select(F.lit("enwiki").alias("wiki"), "qid", "page_title", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(1).cast("bigint").alias("version"))
    tables.upsert_vectors(t.spark, path, first)
    second = first.where("qid % 3 = 0").withColumns({"page_title": F.concat("page_title", F.lit("_new")), "embedding": F.reverse("embedding"), "version": F.lit(2).cast("bigint")})
    found = tables.upsert_vectors(t.spark, path, second)
    return found.select("wiki", "qid", "page_title", F.round(F.get("embedding", 0).cast("double"), 6).alias("first"), F.size("embedding").cast("bigint").alias("length"), "version")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Testbed(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return oracle.all_sql()
