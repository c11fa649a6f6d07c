"""Exact centroid clustering of vectors over a vector-approximation file.

Vectors are whole numbers, floor(scale * component). Two tables hold them: the full vectors, and their approximations, a
cell of ``BITS`` bits a dimension beside the exact squared norm. A round reads the approximations only: for each
dimension, cell and centroid a lookup table has the least and the greatest part that the cell can add to the distance, so that
their sums give each centroid's distance as an interval. Centroids whose interval starts beyond the end of another's
are out. Where one is left the vector is settled; where several intervals overlap, the full vector is fetched by a join on its row
and its distances to those centroids decide. The norm is common to all centroids and so takes no part in the intervals.

Sums of a cluster change only by vectors that change their cluster; they are fetched as well. Distances are computed once,
at the end, of all. The driver holds centroids and edges of cells only. Each round's table is written to the shared folder and the one
before it deleted, so no lineage grows.
"""

from __future__ import annotations

import hashlib
import statistics
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import delete_folder, shared_folder

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, 1
BITS = 6
LARGEST = 2**24
"""Whole components beyond this are held at it, so that distances and their sums fit a long."""
ROWS_AT_ONCE = 4096


def _numbers(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Rows of equal length from a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE))


def whole_vectors(table: DataFrame, vector: str, key: str, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(key, ints) of the vectors with exactly ``dimensions`` components, none null or non-finite; ``ints`` are 32-bit numbers, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dimensions), False))
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimensions)
            fine = np.isfinite(values).all(1)  # a null component has become one that is not a number
            with np.errstate(over="ignore"):
                ints = np.clip(np.floor(values[fine] * scale), -LARGEST, LARGEST).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fine)), _binary(ints)], ["key", "ints"])

    kind = table.schema[key].dataType.simpleString()
    found = table.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    return found.mapInArrow(run, f"key {kind}, ints binary")


@dataclass
class Cells:
    """Cells of each dimension: cell j holds the whole numbers from ``low[:, j]`` to ``high[:, j]``."""

    low: np.ndarray
    high: np.ndarray
    bits: int

    @property
    def dimensions(self) -> int:
        return len(self.low)

    def of(self, ints: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.low[d, 1:], ints[:, d], "right") for d in range(self.dimensions)], 1).astype(np.uint8)

    def packed(self, cells: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return np.packbits(bits.reshape(len(cells), -1), axis=1)

    def unpacked(self, data: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(data, axis=1)[:, : self.dimensions * self.bits].reshape(len(data), self.dimensions, self.bits)
        return (bits * (1 << np.arange(self.bits - 1, -1, -1, dtype=np.uint8))).sum(2, dtype=np.uint8)

    @property
    def width(self) -> int:
        """Bytes of a packed row."""
        return -(-self.dimensions * self.bits // 8)

    def bounds(self, centroids: np.ndarray) -> np.ndarray:
        """[dimension, cell, 2 x centroid]: the least and then the greatest of c * c - 2 * c * x over the cell's numbers x."""
        c = centroids.T[:, None, :]
        ends = np.stack([c * c - 2 * c * self.low[:, :, None], c * c - 2 * c * self.high[:, :, None]])
        return np.concatenate([ends.min(0), ends.max(0)], 2)


def fit_cells(vectors: DataFrame, dimensions: int = DIMENSIONS, bits: int = BITS) -> Cells | None:
    """Cells that a bell curve of each dimension's mean and spread fills alike; the outer ones end at the least and the greatest number.

    One pass over all vectors sums within tasks. None where there is no vector. Where cells lie decides how many vectors are
    fetched, never a result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(dimensions), np.zeros(dimensions)
        low, high = np.full(dimensions, LARGEST), np.full(dimensions, -LARGEST)
        for batch in _slices(batches):
            ints = _numbers(batch.column(0), np.int32, dimensions)
            if not len(ints):
                continue
            n += len(ints)
            total += ints.sum(0)
            squares += (ints.astype(float) ** 2).sum(0)
            low, high = np.minimum(low, ints.min(0)), np.maximum(high, ints.max(0))
        if n:
            columns = [[n] * dimensions, np.arange(dimensions), total, squares, low, high]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64()), strict=True)],
                ["n", "at", "total", "squares", "low", "high"],
            )

    sums = vectors.select("ints").mapInArrow(run, "n long, at int, total double, squares double, low long, high long")
    sums = sums.groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = sums.orderBy("at").toPandas()  # a row a dimension
    if found.empty:
        return None
    mean = (found.total / found.n).to_numpy()
    spread = np.sqrt(np.maximum(found.squares / found.n - mean**2, 0)).to_numpy()
    curve = statistics.NormalDist()
    quantiles = np.array([curve.inv_cdf(i / 2**bits) for i in range(1, 2**bits)])
    least, most = found.low.to_numpy()[:, None], found.high.to_numpy()[:, None]
    edges = np.clip(np.ceil(mean[:, None] + spread[:, None] * quantiles).astype(np.int64), least, most + 1)
    # An empty cell, between equal edges, has a high below its low; no vector is in it.
    return Cells(np.concatenate([least, edges], 1), np.concatenate([edges - 1, most], 1), bits)


def approximate(vectors: DataFrame, cells: Cells) -> DataFrame:
    """(row, cells, cluster): each vector's packed cells; no cluster yet, which is -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            packed = cells.packed(cells.of(_numbers(batch.column(1), np.int32, cells.dimensions)))
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(packed), pa.array([-1] * len(packed), pa.int32())], ["row", "cells", "cluster"])

    return vectors.select("row", "ints").mapInArrow(run, "row long, cells binary, cluster int")


def narrow(approximations: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """(row, cells, cluster, near, left): ``left`` marks the centroids whose interval overlaps the nearest end, ``near`` is the only one or -1."""
    bounds, k = cells.bounds(centroids), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            at = cells.unpacked(_numbers(batch.column(1), np.uint8, cells.width))
            total = np.zeros((len(at), 2 * k), np.int64)
            for d in range(cells.dimensions):
                total += bounds[d][at[:, d]]
            left = total[:, :k] <= total[:, k:].min(1)[:, None]
            near = np.where(left.sum(1) == 1, left.argmax(1), -1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near, pa.int32()), _binary(np.packbits(left, axis=1))], ["row", "cells", "cluster", "near", "left"]
            )

    return approximations.mapInArrow(run, "row long, cells binary, cluster int, near int, left binary")


def settle(fetched: DataFrame, centroids: np.ndarray, kind: str) -> DataFrame:
    """Clusters of fetched vectors by their exact distances to the centroids left, ties to the smaller number.

    Rows of vectors are (row, key, cells, cluster, distance). After a task's vectors come rows (cluster, n, sums): by how much
    the vectors that changed their cluster change a cluster's number and sums.
    """
    k, dimensions = centroids.shape
    names = ["row", "key", "cells", "cluster", "distance", "n", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        schema = None
        for batch in _slices(batches):
            schema = batch.schema
            ints = _numbers(batch.column(5), np.int32, dimensions).astype(np.int64)
            left = np.unpackbits(_numbers(batch.column(4), np.uint8, -(-k // 8)), axis=1)[:, :k].astype(bool)
            at, centroid = np.nonzero(left)
            distances = np.full((len(ints), k), np.iinfo(np.int64).max)
            distances[at, centroid] = ((ints[at] - centroids[centroid]) ** 2).sum(1)
            cluster, before = distances.argmin(1), batch.column(3).to_numpy()
            moved = np.flatnonzero(cluster != before)
            np.add.at(sums, cluster[moved], ints[moved])
            n += np.bincount(cluster[moved], minlength=k)
            gone = moved[before[moved] >= 0]
            np.subtract.at(sums, before[gone], ints[gone])
            n -= np.bincount(before[gone], minlength=k)
            nothing = [pa.nulls(len(ints), pa.int64()), pa.nulls(len(ints), pa.list_(pa.int64()))]
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(cluster, pa.int32()), pa.array(distances.min(1)), *nothing]
            yield pa.RecordBatch.from_arrays(columns, names)
        full = np.flatnonzero(n | (sums != 0).any(1))
        if len(full):
            nothing = [pa.nulls(len(full), schema.field(i).type) for i in range(3)]
            parts = [*nothing, pa.array(full, pa.int32()), pa.nulls(len(full), pa.int64()), pa.array(n[full]), pa.array(sums[full].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(parts, names)

    rows = fetched.select("row", "key", "cells", "cluster", "left", "ints")
    return rows.mapInArrow(run, f"row long, key {kind}, cells binary, cluster int, distance long, n long, sums array<long>")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[bytes]:
    """The vectors with the smallest SHA-256 of seed and key, in that order; equal keys by their numbers, a null key as an empty one."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    return [bytes(r["ints"]) for r in vectors.select(hashed.alias("hash"), "ints").orderBy("hash", "ints").limit(k).collect()]


def _moved(settled: DataFrame, n: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and sums of the clusters after the changes that a round's table has; the driver gets a row a cluster."""
    n, sums = n.copy(), sums.copy()
    each = [F.sum(F.get("sums", F.lit(i))).alias(f"x{i}") for i in range(sums.shape[1])]
    for r in settled.where("sums is not null").groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect():
        n[r["cluster"]] += r["n"]
        sums[r["cluster"]] += [r[f"x{i}"] for i in range(sums.shape[1])]
    return n, sums


def _with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds each cluster's sum of distances, that of all, and the digest of its centroid; a row a cluster is broadcast."""
    sums = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(c, d, sum(sums.values()), digests[c]) for c, d in sums.items()]
    by_cluster = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.select("key", "cluster", "distance").join(F.broadcast(by_cluster), "cluster").select("key", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster(
    table: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
    scale: int = SCALE, seed: int = SEED, bits: int = BITS,
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept.

    Kept are vectors of exactly ``dimensions`` components, none null or non-finite. The first centroids are the ``k`` vectors
    whose keys hash lowest, or all where there are fewer. Each round assigns all vectors to the nearest centroid, ties to the smaller number,
    and moves each centroid to the floor of its vectors' mean; one without vectors stays. Repeated rows are vectors of their own, which
    the deal by row number spreads; other columns are not carried. No vector gives an empty result.
    """
    spark, kind, folder = table.sparkSession, table.schema[key].dataType.simpleString(), shared_folder(table.sparkSession, "clusters")
    whole_vectors(table, vector, key, dimensions, scale).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{folder}/vectors")
    vectors = spark.read.parquet(f"{folder}/vectors")
    schema = f"key {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    cells = fit_cells(vectors, dimensions, bits)
    if cells is None:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    centroids = np.stack([np.frombuffer(c, np.int32).astype(np.int64) for c in first_centroids(vectors, k, seed)])
    n, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
    # Dealt by row once and kept so, that no later join has to move the full vectors.
    full = vectors.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row").persist(StorageLevel.DISK_ONLY)
    before = f"{folder}/0"
    approximate(vectors, cells).write.parquet(before)
    for i in range(1, rounds + 2):
        last = i == rounds + 1
        state = spark.read.parquet(before).where("row is not null").select("row", "cells", "cluster")
        narrow(state, cells, centroids).write.parquet(f"{folder}/{i}_seen")
        seen = spark.read.parquet(f"{folder}/{i}_seen")
        fetch = F.lit(last) | (F.col("near") < 0) | (F.col("near") != F.col("cluster"))
        settled = settle(seen.where(fetch).join(full, "row"), centroids, kind)
        settled.unionByName(seen.where(~fetch).select("row", "cells", "cluster"), allowMissingColumns=True).write.parquet(f"{folder}/{i}")
        after = spark.read.parquet(f"{folder}/{i}")
        if not last:
            n, sums = _moved(after, n, sums)
            centroids = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centroids)
        delete_folder(spark, before)
        delete_folder(spark, f"{folder}/{i}_seen")
        before = f"{folder}/{i}"
    full.unpersist()
    return _with_inertia(after.where("row is not null"), centroids).withColumnRenamed("key", key)
