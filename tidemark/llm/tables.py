"""Table access shared by the registered queries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 100_000
"""Most rows that one row expands to within a task."""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text or of another kind of bytes; a longer value is a part of its own."""
    start = size = 0
    for i, value in enumerate(batch.column(column)):
        n = value.as_buffer().size if value.is_valid else 0
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def expanded(rows: DataFrame, n: str, place: str) -> DataFrame:
    """Each row as often as its column ``n`` says, with the long column ``place`` from 0 in place of it.

    A row of many is first split into pieces of ``PIECE``, which are dealt out before they expand, so that no task and no
    array holds all of it.
    """
    columns, at = [c for c in rows.columns if c != n], free_name(rows, "__piece")
    few = rows.where(F.col(n) <= PIECE).select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(place))
    starts = rows.where(F.col(n) > PIECE).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(PIECE).cast("long"))).alias(at))
    end = F.least(F.col(at) + PIECE, F.col(n)) - 1
    many = starts.repartition(at, *columns).select(*columns, F.explode(F.sequence(F.col(at), end)).alias(place))
    return few.unionByName(many)
