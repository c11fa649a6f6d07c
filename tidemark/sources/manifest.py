"""Partitioned tables that change as one: data is written first, and one rename makes it visible.

A commit writes its partitions into a generation folder of its own, below ``path``/<kind>/generation=<name>, and then a
manifest, ``path``/manifest/<n>, that says for each live partition of each kind which generation has it. Readers take the
manifest with the highest number. A job that dies before the rename leaves them on the state before; a second writer that
began from the same state fails at the rename instead of losing the first one's partitions. Generations that nothing names are removed by ``vacuum``.

The driver handles names of generations and of partitions, as Spark's own listing does, never rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lineage import delete_folder

ROWS = "kind string, part string, generation string, written long"
"""A live partition, such as wiki=enwiki/date=2024-01-31, and how many partitions its generation has of that kind."""


def _names(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []


def _publish(spark: SparkSession, made: str, name: str) -> None:
    """Renames a finished folder; fails where the new name is taken."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(name)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.getFileSystem(conf).makeQualified(to).toUri(), conf)
    context.rename(jvm.org.apache.hadoop.fs.Path(made), to, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))


@dataclass
class Manifest:
    """One state of the tables at ``path``: that of manifest ``number``, 0 before the first."""

    spark: SparkSession
    path: str
    number: int
    rows: DataFrame

    @classmethod
    def latest(cls, spark: SparkSession, path: str) -> Manifest:
        number = max((int(n) for n in _names(spark, f"{path}/manifest") if n.isdigit()), default=0)
        rows = spark.read.schema(ROWS).parquet(f"{path}/manifest/{number}") if number else spark.createDataFrame([], ROWS)
        return cls(spark, path, number, rows)

    def scan(self, kind: str, schema: str, part: Column | None = None, rows: Column | None = None) -> DataFrame:
        """The live rows of a kind; ``part`` chooses partitions by their names, ``rows`` by their columns, and both must agree.

        A generation of which all is live is read by its folder, so that Spark prunes it; of any other only the folders chosen are named.
        """
        own = self.rows.where(F.col("kind") == kind).withColumn("wanted", F.lit(True) if part is None else part)
        counts = own.groupBy("generation", "written").agg(F.count("*").alias("live"), F.count_if("wanted").alias("wanted")).where("wanted > 0").collect()
        paths = [f"{self.path}/{kind}/generation={r['generation']}" for r in counts if r["live"] == r["written"]]
        mixed = [r["generation"] for r in counts if r["live"] != r["written"]]
        if mixed:
            named = own.where(F.col("wanted") & F.col("generation").isin(mixed)).select("generation", "part")
            paths += [f"{self.path}/{kind}/generation={r['generation']}/{r['part']}" for r in named.collect()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*sorted(paths))
        return found.where(rows) if rows is not None else found

    def write(self, kind: str, table: DataFrame, parts: list[str], generation: str, dealt: bool = False) -> Manifest:
        """Writes partitions that replace those of the same name, and returns the state with them, which nobody sees before ``commit``.

        ``dealt`` says that each task of ``table`` has rows of few partitions already, so that they are written as they lie.
        """
        folder = f"{self.path}/{kind}/generation={generation}"
        if not dealt:
            tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # a stated number, as many small folders are work that small data hides
            table = table.repartition(tasks, *parts)
        table.write.partitionBy(*parts).parquet(folder)
        found = [""]
        for _ in parts:
            found = [f"{f}/{n}" for f in found for n in _names(self.spark, f"{folder}{f}") if "=" in n]
        return self.put(kind, [f[1:] for f in found], generation)

    def put(self, kind: str, parts: Iterable[str], generation: str) -> Manifest:
        """The state in which the generation has these partitions."""
        names = sorted(set(parts))
        if not names:
            return self
        new = self.spark.createDataFrame([(kind, n, generation, len(names)) for n in names], ROWS)
        return Manifest(self.spark, self.path, self.number, self.rows.join(new.select("kind", "part"), ["kind", "part"], "left_anti").select(*new.columns).unionByName(new))

    def commit(self) -> None:
        """Makes this state the one after the one it was made from."""
        made = f"{self.path}/manifest/_{uuid.uuid4().hex}"
        self.rows.coalesce(1).write.parquet(made)
        _publish(self.spark, made, f"{self.path}/manifest/{self.number + 1}")

    def vacuum(self) -> list[str]:
        """Deletes older manifests and the generations that this one names nowhere; returns their paths. No other writer or older reader may run."""
        live = {(r["kind"], r["generation"]) for r in self.rows.select("kind", "generation").distinct().collect()}
        old = [f"{self.path}/manifest/{n}" for n in _names(self.spark, f"{self.path}/manifest") if n != str(self.number)]
        for kind in _names(self.spark, self.path):
            if kind != "manifest":
                names = (n.removeprefix("generation=") for n in _names(self.spark, f"{self.path}/{kind}"))
                old += [f"{self.path}/{kind}/generation={n}" for n in names if (kind, n) not in live]
        for path in old:
            delete_folder(self.spark, path)
        return old


def new_generation() -> str:
    return uuid.uuid4().hex
