"""Daily views from a folder of dump files, as a stream with its sums in the state store, on disk."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.lineage import cut
from tidemark.sources import dumps, schemas
from tidemark.sources.daily import write_daily_views
from tidemark.sources.dumps import FILE_DAY
from tidemark.sources.manifest import Manifest

LATE = "400 days"
STORE = "spark.sql.streaming.stateStore"
ON_DISK = {
    f"{STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{STORE}.rocksdb.changelogCheckpointing.enabled": "true",
}
"""Sums as RocksDB files with a bound on an executor's memory for them; Spark's other store holds all sums in its heap."""


def running_sums(lines: DataFrame, articles: DataFrame, file_day: str = FILE_DAY, late: str = LATE) -> DataFrame:
    """(wiki, date, article_qid, views) of streamed dump lines (value, file): the sum of each article and day, kept as state.

    The day's watermark follows the newest day by ``late``; state of days before it is let go, and lines of such days are dropped.
    """
    day = F.to_date(F.regexp_extract("file", file_day, 1), "yyyyMMdd")
    views = dumps.normalize_pageviews(dumps.parse_dump_lines(lines.withColumn("__day", day), F.col("__day")))
    known = articles.select("wiki", "page_id", F.col("qid").alias("article_qid"))
    found = views.join(known, ["wiki", "page_id"]).withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", late)
    return found.groupBy("wiki", "at", "article_qid").agg(F.sum("daily_views").alias("views")).select("wiki", F.to_date("at").alias("date"), "article_qid", "views")


def merge_days(changed: DataFrame, path: str) -> None:
    """Puts changed sums (wiki, date, article_qid, views) in place of those in the table; of the days touched the other rows stay."""
    spark = changed.sparkSession
    part = F.concat(F.lit("wiki="), "wiki", F.lit("/date="), F.col("date").cast("string"))
    touched = [r["part"] for r in changed.select(part.alias("part")).distinct().collect()]  # names of partitions
    old = Manifest.latest(spark, path).scan("days", schemas.DAILY_VIEWS, F.col("part").isin(touched), part.isin(touched))
    kept = old.join(changed.select("wiki", "date", "article_qid"), ["wiki", "date", "article_qid"], "left_anti")
    write_daily_views(kept.select(*changed.columns).unionByName(changed), path)


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Settings of a query that starts inside; a query takes the session's settings when it starts, and a checkpoint keeps the store it began with."""
    before = {k: spark.conf.get(k, None) for k in ON_DISK}
    try:
        for k, v in ON_DISK.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_daily_views(
    spark: SparkSession, source: str, articles: DataFrame, target: str, state: str, file_day: str = FILE_DAY, late: str = LATE, files_at_once: int = 1000,
    by_name: bool = True,
) -> StreamingQuery:
    """Takes in all new dump files in ``source``, in batches of ``files_at_once``, and keeps the table of daily views at ``target`` up to date.

    A file's day is the first group of ``file_day`` in its path, by default the last eight digits of its name. Sums are kept in the state
    store by edition, day and article, so a batch adds to them and never reads earlier lines again; what changed is merged into the days it touches. A file
    is known by its name: one that comes again, in whatever folder, is not counted again; without ``by_name`` its whole path counts. A batch that is repeated after a failure gives the same
    sums. Files of a day may come late, by up to ``late`` after the newest.
    """
    lines = (
        spark.readStream.format("text").option("fileNameOnly", str(by_name).lower()).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", "true")
        .load(source).select("value", F.input_file_name().alias("file"))
    )

    def take(batch: DataFrame, _: int) -> None:
        changed = cut(batch)
        if not changed.isEmpty():
            merge_days(changed, target)

    sums = running_sums(lines, articles, file_day, late)
    with _state_on_disk(spark):
        return sums.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", state).trigger(availableNow=True).start()
