"""Tables dealt into buckets by a key when they are written, so that joins and sums on the key do not move them again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def write_bucketed(table: DataFrame, path: str, key: str, buckets: int = BUCKETS, name: str | None = None) -> str:
    """Writes the table to ``path`` in buckets of ``key``, in files sorted by it; returns the name it has in the session's catalog.

    Tables that share key and number of buckets meet without an exchange on either side; a smaller table that is not
    bucketed is dealt to the buckets, and a larger one stays where it is. Without a ``name`` the catalog gets a new one. Rows with a null key share a bucket.
    Where the session has more partitions than there are buckets, a bucket is sorted and written by several tasks.
    """
    name = name or f"bucketed_{uuid.uuid4().hex}"
    # A multiple of the buckets, so that a task has rows of one bucket only.
    dealt = table.repartition(buckets * max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets), key)
    dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return name


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
