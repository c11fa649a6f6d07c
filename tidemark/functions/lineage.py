"""Folders that all executors share, and cutting lineage through them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _fallback(spark: SparkSession, prefix: str) -> str:
    """A temporary folder, for a session without executors of its own, as in tests."""
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir`` for tables that a job writes and reads again."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _fallback(spark, "shared-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed now and read back from ``spark.checkpoint.dir``.

    Where neither that setting nor a folder of the context exists, a local session uses a temporary folder; any other raises.
    Spark deletes the files with the frame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or _fallback(df.sparkSession, "checkpoint-"))
    return df.checkpoint()


def cut_counted(df: DataFrame, condition: str) -> tuple[DataFrame, int]:
    """``cut``, and how many rows meet the condition, counted in the same job."""
    seen = Observation()
    kept = cut(df.observe(seen, F.expr(f"count_if({condition}) as n")))
    return kept, seen.get["n"]
