"""Sharding by a hierarchical weighted hash tree, in built-in functions only.

A row descends region, rack and shard. At each node every child draws ``-ln(u) / weight`` from a hash of the row's
key and the child's path, and the smallest draw wins, so a child gets rows in proportion to its weight. A changed
weight changes only that child's draws: rows move only into or out of the subtrees whose weights changed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import expanded

Tree = dict[int, dict[int, dict[int, float]]]
"""region -> rack -> shard -> weight"""

REGIONS, RACKS, SHARDS_PER_RACK = 3, 2, 4
ROW_OVERHEAD = 8
SLOT_BUCKETS = 256


def topology(n_shards: int, regions: int = REGIONS, racks: int = RACKS, per_rack: int = SHARDS_PER_RACK) -> Tree:
    """The tree of ``n_shards`` equal shards.

    The first ``regions * racks * per_rack`` shards fill the fixed regions in order. Each further shard opens a region
    of its own, so that adding it changes no weight but its own and rows move only into it.
    """
    base = regions * racks * per_rack
    tree: Tree = {}
    for shard in range(n_shards):
        region = shard // (racks * per_rack) if shard < base else regions + shard - base
        rack = shard // per_rack % racks if shard < base else 0
        tree.setdefault(region, {}).setdefault(rack, {})[shard] = 1.0
    return tree


def _weight(node: dict | float) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else node


def _winner(key: Column, path: list[Column], weights: list[Column]) -> Column:
    """Position of the child with the smallest weighted draw under the node at ``path``.

    Equal draws go to the smaller position; a child of weight null does not take part.
    """
    draws = []
    for child, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(*path, F.lit(child), key), 11)
        draw = -F.log((bits.cast("double") + 0.5) * F.lit(2.0**-53)) / weight
        draws.append(F.when(weight.isNotNull(), F.struct(draw.alias("draw"), F.lit(child).alias("child"))))
    return F.array_min(F.array(*draws))["child"] if len(draws) > 1 else F.lit(0)


def _table(values: list, kind: str, *path: Column) -> Column:
    """Entry of a nested literal list at ``path``; null beyond its ends."""
    out = F.from_json(F.lit(json.dumps(values)), F.lit("array<" * len(path) + kind + ">" * len(path)))
    for position in path:
        out = F.get(out, position)
    return out


def with_shard(df: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """Adds the int column ``name``: the shard that ``key`` descends to. A null key is one key like any other."""
    region, rack, slot = (f"__{name}_{level}" for level in ("region", "rack", "slot"))
    racks = [list(r.values()) for r in tree.values()]
    shards = [[list(k.items()) for k in r] for r in racks]
    df = df.withColumn(region, _winner(key, [F.lit("region")], [F.lit(float(_weight(r))) for r in tree.values()]))
    by_rack = [[_weight(k) for k in r] for r in racks]
    at = [F.col(region)]
    most = max(map(len, racks))
    df = df.withColumn(rack, _winner(key, [F.lit("rack"), *at], [_table(by_rack, "double", *at, F.lit(j)) for j in range(most)]))
    by_shard = [[[w for _, w in k] for k in r] for r in shards]
    at = [F.col(region), F.col(rack)]
    most = max(len(k) for r in shards for k in r)
    df = df.withColumn(slot, _winner(key, [F.lit("shard"), *at], [_table(by_shard, "double", *at, F.lit(j)) for j in range(most)]))
    ids = _table([[[s for s, _ in k] for k in r] for r in shards], "int", *at, F.col(slot))
    # Never null: else the join on it would push a null test, with all the draws in it, down to the scan.
    return df.withColumn(name, F.coalesce(ids, F.lit(0))).drop(region, rack, slot)


def with_slot(rows: DataFrame, shard: str, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Adds the long column ``slot``, which numbers the rows of each shard from 0 without gaps.

    Equal rows are counted before the shuffle and expanded at the end, many of them in pieces, so no group of copies meets in one task. A
    shard's rows are dealt into ``buckets`` hash buckets; the buckets' totals give each bucket's first slot. Only those
    totals, at most shards x buckets rows, are broadcast.
    """
    columns = rows.columns
    bucket = F.coalesce(F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int"), F.lit(0))
    counted = rows.groupBy(*columns).agg(F.count("*").alias("__n")).withColumn("__bucket", bucket)
    by_bucket = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        counted.groupBy(shard, "__bucket").agg(F.sum("__n").alias("__total"))
        .select(shard, "__bucket", F.coalesce(F.sum("__total").over(by_bucket), F.lit(0)).alias("__first"))
    )
    inside = Window.partitionBy(shard, "__bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    start = F.col("__first") + F.col("__before")
    started = placed.join(F.broadcast(first), [shard, "__bucket"]).select(*columns, "__n", start.alias("__start"))
    return expanded(started, "__n", "__place").select(*columns, (F.col("__start") + F.col("__place")).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 24, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Shard, slot and next shard of every document, under the law ``key``.

    Size is the text's UTF-8 bytes plus 8; a null text counts as empty. Rows of one key share a shard, null keys
    included. Fully equal rows get slots of their own. Other columns are not carried.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(whole) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"),
    )
    rows = with_shard(rows, F.col(key), topology(n_shards), "shard")
    rows = with_shard(rows, F.col(key), topology(n_shards + 1), "grown_shard")
    return with_slot(rows, "shard").select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
