"""Exact cosine search over vectors laid out by cluster, of which those are skipped that cannot hold a better one.

Unit vectors lie by the nearest of some centroids. By the triangle inequality of angles no vector of a cluster is nearer to a query than the
query's angle to the centroid less the cluster's radius. A search first scores, for each query, the clusters nearest to it until they hold as many
vectors as are asked for; the last of these scores is a floor, and only clusters that may lie above it are scored then. Results
are those of a search over all vectors. Where the centroids come from decides how much is skipped, nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut

CENTROIDS = 256
"""Most clusters of an index; the driver holds their centroids and radii."""
SPREAD = 16
"""Tasks that may write a cluster, so that a large one is no single task's."""
QUERY_BLOCK = 1000
SLACK = 1e-6
"""What rounding of scores to six digits and of angles may add to a bound."""


def _units(rows: list, size: int) -> np.ndarray:
    """Unit vectors of the rows; rows that have none, as they are null, zero or of another size, are not numbers."""
    out = np.full((len(rows), size), np.nan)
    for i, r in enumerate(rows):
        if r is not None and len(r) == size and None not in r:
            out[i] = r
    with np.errstate(invalid="ignore", divide="ignore"):
        out /= np.sqrt((out * out).sum(1))[:, None]
    return out


@dataclass
class Index:
    """Vectors at ``path``, (qid, embedding, cluster), and of each cluster its centroid, its radius as an angle and its size."""

    path: str
    schema: str
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def build_index(vectors: DataFrame, path: str, clusters: int = CENTROIDS) -> Index:
    """Lays all vectors with a direction out by the nearest of ``clusters`` of them, chosen by hash; others are never found by a search and left out."""
    spark = vectors.sparkSession
    first = vectors.where("embedding is not null").select("embedding").orderBy(F.xxhash64("qid"), "qid").limit(clusters).toArrow().column(0).to_pylist()
    size = max((len(f) for f in first), default=0)
    centroids = _units(first, size)
    centroids = centroids[~np.isnan(centroids).any(1)]
    kind = vectors.schema["qid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column(1).to_pylist(), size)
            fit = np.flatnonzero(~np.isnan(units).any(1)) if len(centroids) else np.zeros(0, int)
            near = units[fit] @ centroids.T if len(fit) else np.zeros((0, 1))
            best = near.argmax(1)
            angle = np.arccos(np.clip(near[np.arange(len(fit)), best], -1, 1))
            kept = batch.take(pa.array(fit))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(best, pa.int32()), pa.array(angle)], ["qid", "embedding", "cluster", "angle"])

    element = vectors.schema["embedding"].dataType.simpleString()
    found = vectors.select("qid", "embedding").mapInArrow(run, f"qid {kind}, embedding {element}, cluster int, angle double")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found.repartition(tasks, "cluster", F.pmod(F.xxhash64("qid"), F.lit(SPREAD))).sortWithinPartitions("cluster").write.partitionBy("cluster").parquet(path)
    schema = f"qid {kind}, embedding {element}, angle double, cluster int"
    stats = spark.read.schema(schema).parquet(path).groupBy("cluster").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()
    radii, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in stats:  # a row a cluster
        radii[r["cluster"]], sizes[r["cluster"]] = r["radius"], r["n"]
    return Index(path, schema, centroids, radii, sizes)


def _scored(index: Index, spark: SparkSession, ids: pa.Array, units: np.ndarray, wanted: np.ndarray, k: int, kind: str) -> DataFrame:
    """(query_id, qid, score) of the queries with the vectors of their wanted clusters; each batch passes on the k best of a query and their ties."""
    clusters = np.flatnonzero(wanted.any(0))
    shared = spark.sparkContext.broadcast((ids, units, wanted))
    table = index.vectors(spark).where(F.col("cluster").isin(clusters.tolist()))
    qid = table.schema["qid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units, wanted = shared.value
        for batch in batches:
            values, cluster = _units(batch.column(1).to_pylist(), units.shape[1]), batch.column(2).to_numpy()
            q, v, s = [], [], []
            for c in np.unique(cluster):
                asked, here = np.flatnonzero(wanted[:, c]), np.flatnonzero(cluster == c)
                scores = np.round(units[asked] @ values[here].T, 6)
                low = -np.inf if len(here) <= k else np.partition(scores, len(here) - k, 1)[:, [-k]]
                a, b = np.nonzero(scores >= low)
                q.append(asked[a])
                v.append(here[b])
                s.append(scores[a, b])
            q, v, s = (np.concatenate(x) if x else np.zeros(0, int) for x in (q, v, s))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), batch.column(0).take(pa.array(v)), pa.array(s, pa.float64())], ["query_id", "qid", "score"])

    return table.select("qid", "embedding", "cluster").mapInArrow(run, f"query_id {kind}, qid {qid}, score double")


def _first_clusters(index: Index, angles: np.ndarray, k: int) -> np.ndarray:
    """[query, cluster]: the nearest clusters that together hold k vectors."""
    order = angles.argsort(1)
    before = np.cumsum(index.sizes[order], 1) - index.sizes[order]
    wanted = np.zeros(angles.shape, bool)
    np.put_along_axis(wanted, order, before < k, 1)
    return wanted


def nearest(queries: DataFrame, index: Index, k: int = 1, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, qid, score, rank): the k best of each query, as ``vectors.most_similar`` gives them.

    Queries go out in blocks of bounded size. Null, zero and unfit queries find nothing.
    """
    return search(queries, index, k, block)[0]


def search(queries: DataFrame, index: Index, k: int, block: int = QUERY_BLOCK) -> tuple[DataFrame, int]:
    """``nearest``, and how many pairs of query and vector were scored for it."""
    spark, kind = queries.sparkSession, queries.schema["query_id"].dataType.simpleString()
    size = index.centroids.shape[1] if index.centroids.ndim == 2 else 0
    asked = cut(queries.select("query_id", "embedding"))
    blocks = -(-asked.count() // block) or 1
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "qid")
    met, scored = spark.createDataFrame([], f"query_id {kind}, qid {index.vectors(spark).schema['qid'].dataType.simpleString()}, score double"), 0
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
        units = _units(rows.column("embedding").to_pylist(), size)
        fit = np.flatnonzero(~np.isnan(units).any(1)) if index.sizes.sum() else np.zeros(0, int)
        if not len(fit):
            continue
        ids, units = rows.column("query_id").combine_chunks().take(pa.array(fit)), units[fit]
        angles = np.arccos(np.clip(units @ index.centroids.T, -1, 1))
        wanted = _first_clusters(index, angles, k)
        near = cut(_scored(index, spark, ids, units, wanted, k, kind))
        best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", "score").toArrow()  # a row a query
        floors = np.full(len(ids), -np.inf)
        floors[pc.index_in(best.column("query_id").combine_chunks(), ids).to_numpy(zero_copy_only=False)] = best.column("score").to_numpy()
        bound = np.cos(np.maximum(angles - index.radii, 0)) + SLACK
        rest = ~wanted & (bound >= floors[:, None]) & (index.sizes > 0)
        scored += int((wanted * index.sizes).sum() + (rest * index.sizes).sum())
        met = met.unionByName(near)
        if rest.any():
            met = met.unionByName(_scored(index, spark, ids, units, rest, k, kind))
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), scored
