"""Walks from many roots at once, 64 roots a number, and strongly connected components of a graph.

A walk's row is a node and a block of up to 64 roots; a bit says whether a root reaches the node. A level is one join with
the edges, one ``bit_or`` and a mask of the bits seen before, so that it moves a row for a node and a block where a walk
root by root moves one for a node and a root. Roots are told apart again only in the result, or not at all where it is a
count or a sum a root.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut, cut_counted, shared_folder

WIDTH = 64
PART = 4096
SMALL = 2_000_000
LISTED, SHARES = 256, 4
"""Roots of a node in one list, and pieces of work for each task where results of few blocks are told apart."""
MET = 8192
"""Rows of a block that a list of roots meets in one piece of work, about."""
HOPS = 2
"""Steps along the edges that a round of the components takes before it is written."""
BATCH = 16_000_000
"""Rows (a node and a block of 64) that depths are counted for at a time. A graph of up to a quarter of that, nodes and edges, goes whole to each executor."""
WORDS = 16
"""Blocks of 64 roots that a task walks from at a time at most, where the graph goes to it."""
LEVELS, TASKS, CUT_EVERY = 4, 64, 16
"""Levels of a round of the depth counts, tasks that a batch is dealt to, and rounds after which lineage is cut."""


def numbered(roots: DataFrame) -> DataFrame:
    """(block, roots): the distinct roots in blocks of up to 64, each an array whose places are the roots' bits; null roots are dropped.

    Rows are numbered within their partition, so no task sees all roots; partitions of fewer than ``PART`` are put together, as each ends
    with a block that may not be full.
    """
    kept = cut(roots.select("root").where("root is not null").distinct())
    parts = max(1, min(kept.rdd.getNumPartitions(), kept.count() // PART))
    kept = kept.coalesce(parts).withColumn("at", F.monotonically_increasing_id())
    place = F.struct(F.col("at").bitwiseAND(WIDTH - 1).alias("bit"), "root")
    return kept.groupBy(F.shiftright("at", 6).alias("block")).agg(F.array_sort(F.collect_list(place)).alias("places")).select("block", F.col("places.root").alias("roots"))


def kept_by(table: DataFrame, key: str) -> DataFrame:
    """The table dealt out by a key and kept so, that joins on the key in many rounds do not move it again."""
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(n, key).persist(StorageLevel.MEMORY_AND_DISK)


def _bit(bits: str, i: int) -> Column:
    return F.shiftrightunsigned(bits, i).bitwiseAND(1)


@contextmanager
def _rounds(spark: SparkSession, rows: int) -> Iterator[None]:
    """Settings for many short jobs in a row over at most so many rows each.

    Up to ``SMALL`` rows, adaptive planning and many partitions would cost more than the work; larger rounds keep the session's settings.
    """
    short = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(min(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))}
    before = {k: spark.conf.get(k) for k in short}
    try:
        for k, v in short.items() if rows <= SMALL else ():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@dataclass
class Walk:
    """What a walk found."""

    blocks: DataFrame
    """(block, roots)"""
    levels: DataFrame
    """(node, block, bits, depth): the roots that first reach the node at that depth."""
    reached: DataFrame
    """(node, block, bits): the roots that reach the node at all, each row once."""

    def by_root(self, table: DataFrame) -> DataFrame:
        """Rows (block, bits, ...) as rows (root, ...), one for each bit that is set."""
        rest = [c for c in table.columns if c not in ("block", "bits")]
        own = F.expr("explode(filter(transform(roots, (r, i) -> if(shiftrightunsigned(bits, i) & 1 = 1, r, null)), r -> r is not null))")
        return table.join(self.blocks, "block").select(own.alias("root"), *rest)

    def by_member(self, table: DataFrame, named: DataFrame, key: str, keys: int = 0) -> DataFrame:
        """Rows (block, bits, ...) as rows (root, ...), one for each root that ``named`` (root, node) puts in a node whose bit is set.

        A node's roots come as lists of some ``LISTED``, told apart last, so that no row is moved for a root. A list meets one row of the table after
        the other: the same few roots follow each other again and again, which a writer packs to little. Where blocks are few, as where one component is most of
        the graph, a block's rows are dealt by ``key`` over many tasks, each of which gets the block's lists; a list meets some ``MET`` rows at a time at
        most, where ``keys`` says how many keys there are.
        """
        tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pieces, shares = max(1, -(-named.count() // LISTED)), max(-(-SHARES * tasks // max(1, self.blocks.count())), -(-keys // MET))
        places = self.blocks.select("block", F.posexplode("roots").alias("bit", "node")).join(named, "node")
        lists = places.groupBy("block", "bit", F.pmod(F.xxhash64("root"), F.lit(pieces)).alias("piece")).agg(F.collect_list("root").alias("__roots"))
        sent = lists.select("block", "bit", "__roots", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("__share"))
        rest = [c for c in table.columns if c not in ("block", "bits")]
        dealt = table.withColumn("__share", F.pmod(F.xxhash64(key), F.lit(shares)).cast("int")).repartition(tasks, "block", "__share")
        met = sent.join(dealt.hint("merge"), ["block", "__share"]).where("shiftrightunsigned(bits, bit) & 1 = 1").select("__roots", *rest)
        # Generated code holds all that a row of the join becomes; cut here, that is a list's rows before and one list's roots after.
        return met.coalesce(tasks * shares).select(F.explode("__roots").alias("root"), *rest)

    def totals(self, table: DataFrame, value: Column, name: str, *by: str) -> DataFrame:
        """(root, *by, name): ``value`` summed over the rows (block, bits, ...) that have the root's bit; no row where none has.

        The sums of a block's 64 roots are columns of one aggregation, so a task passes on a row a block, whatever it reads.
        """
        sums = [F.sum(F.when(_bit("bits", i) == 1, value)).alias(f"__{i}") for i in range(WIDTH)]
        wide = table.groupBy("block", *by).agg(*sums).join(self.blocks, "block")
        rows = wide.select(*by, "roots", F.posexplode(F.array(*[f"__{i}" for i in range(WIDTH)])).alias("__bit", name))
        return rows.where(F.col(name).isNotNull()).select(F.get("roots", F.col("__bit")).alias("root"), *by, name)


def walk(roots: DataFrame, edges: DataFrame, max_depth: int | None = None) -> Walk:
    """Follows child edges (parent_qid, child_qid) from all roots, breadth first, to ``max_depth`` or as far as they lead.

    Bits seen before are masked out, so cycles end. Each level is kept in the checkpoint folder: lineage does not grow and a lost executor costs
    one level.
    """
    blocks = cut(numbered(roots))
    steps = cut(edges.select(F.col("parent_qid").alias("node"), F.col("child_qid").alias("next")).distinct())
    n_blocks, n_roots = blocks.agg(F.count("*"), F.coalesce(F.sum(F.size("roots")), F.lit(0))).first()
    with _rounds(blocks.sparkSession, (steps.count() + n_roots) * n_blocks):
        levels, reached = _levels(blocks, steps, max_depth)
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return Walk(blocks, whole, reached)


def _levels(blocks: DataFrame, steps: DataFrame, max_depth: int | None) -> tuple[list[DataFrame], DataFrame]:
    steps = kept_by(steps, "node")
    start = blocks.select("block", F.posexplode("roots").alias("bit", "node"))
    state = cut(start.selectExpr("node", "block", "shiftleft(1L, bit) as seen", "shiftleft(1L, bit) as fresh"))
    levels = [state.selectExpr("node", "block", "fresh as bits", "0 as depth")]
    while max_depth is None or len(levels) <= max_depth:
        reached = state.where("fresh <> 0").join(steps, "node").selectExpr("next as node", "block", "0L as seen", "fresh as new")
        met = state.selectExpr("node", "block", "seen", "0L as new").union(reached).groupBy("node", "block").agg(F.expr("bit_or(seen) as seen"), F.expr("bit_or(new) as new"))
        state, n = cut_counted(met.selectExpr("node", "block", "seen | new as seen", "new & ~seen as fresh"), "fresh <> 0")
        if not n:
            break
        levels.append(state.where("fresh <> 0").selectExpr("node", "block", "fresh as bits", f"{len(levels)} as depth"))
    steps.unpersist()
    return levels, state.select("node", "block", F.col("seen").alias("bits"))


def depth_counts(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, depth, n): how many nodes lie at each depth below each root, the root itself at 0.

    A graph of bounded size goes to all executors, as edges that Spark broadcasts would, and tasks walk it from their own roots: see ``_held_counts``.
    In any other, where the roots are at least half of all nodes, the walk goes backward from all nodes, 64 of them a number, so that a row is a root and
    a block of what lies below it, and a count is that of its bits. Fewer roots are walked from. Either way blocks are walked in batches of ``BATCH`` rows;
    a batch is dealt out by block once, no level moves it as long as Spark broadcasts the edges, and of a batch only its counts are kept.
    """
    spark = edges.sparkSession
    arcs = cut(edges.select(F.col("parent_qid").alias("node"), F.col("child_qid").alias("next")).dropna().distinct())
    asked = cut(roots.select(F.col("root").alias("node")).where("node is not null").distinct())
    nodes = cut(asked.union(arcs.select("node")).union(arcs.select("next")).distinct())
    n, n_asked = nodes.count(), asked.count()
    size = n + arcs.count()
    if size <= BATCH // 4:
        return _held_counts(asked, arcs, n_asked, size)
    backward = 2 * n_asked >= n
    if backward:
        arcs = arcs.selectExpr("next as node", "node as next")
    folder = shared_folder(spark, "arcs")
    # A table of files, as Spark knows the size of one. A node's own row keeps what it has seen.
    arcs.selectExpr("node", "next", "false as own").union(nodes.selectExpr("node", "node", "true")).write.parquet(folder)
    blocks = cut(numbered((nodes if backward else asked).withColumnRenamed("node", "root")))
    rows = n * max(1, blocks.count())
    batches, counts = -(-rows // BATCH), []
    with _rounds(spark, rows):
        tasks = min(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        arcs = spark.read.schema("node bigint, next bigint, own boolean").parquet(folder)
        for i in range(batches):
            own = blocks.where(F.pmod(F.xxhash64("block"), F.lit(batches)) == i)
            counts += _batch_counts(own, arcs, tasks, backward)
    whole = counts[0]
    for part in counts[1:]:
        whole = whole.unionByName(part)
    found = whole.groupBy("root", "depth").agg(F.sum("n").alias("n"))
    return found.join(asked.withColumnRenamed("node", "root"), "root", "left_semi") if backward else found


def _held_counts(asked: DataFrame, arcs: DataFrame, n_asked: int, size: int) -> DataFrame:
    """``depth_counts`` of a graph of up to ``BATCH // 4`` nodes and edges, which is broadcast: roots are dealt to tasks, and nothing else is moved or kept.

    A task walks from some ``WORDS`` blocks of roots at once, a node's row of bits a step; a larger graph is walked from fewer, so that memory is bounded.
    """
    ends = arcs.select("node", "next").toArrow()
    names, places = np.unique(np.concatenate([ends.column(i).to_numpy() for i in (0, 1)]), return_inverse=True)
    parent, child = np.split(places.astype(np.int32), 2)
    starts = np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=len(names)))])
    shared = arcs.sparkSession.sparkContext.broadcast((names, starts, child[np.argsort(parent, kind="stable")]))
    together = WIDTH * max(1, min(WORDS, BATCH // max(1, size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, starts, nexts = shared.value
        own = pa.chunked_array([b.column(0) for b in batches], kind)
        ids = own.to_numpy()
        known = np.isin(ids, names)
        for part in np.array_split(np.flatnonzero(known), max(1, round(len(ids) / together))):
            for depth, counts in enumerate(_walked(starts, nexts, np.searchsorted(names, ids[part]))):
                some = np.flatnonzero(counts)
                yield _rows(own.take(pa.array(part[some])), depth, counts[some])
        alone = np.flatnonzero(~known)
        yield _rows(own.take(pa.array(alone)), 0, np.ones(len(alone), np.int64))

    def _rows(roots: pa.ChunkedArray, depth: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([roots.combine_chunks(), pa.array(np.full(len(counts), depth, np.int32)), pa.array(counts)], ["root", "depth", "n"])

    kind = asked.limit(0).toArrow().schema.field(0).type
    return asked.repartition(-(-n_asked // together) or 1).mapInArrow(run, f"root {asked.schema['node'].dataType.simpleString()}, depth int, n bigint")


def _walked(starts: np.ndarray, nexts: np.ndarray, roots: np.ndarray) -> Iterator[np.ndarray]:
    """For each depth, how many nodes lie at it below each root; node i leads to ``nexts[starts[i]:starts[i + 1]]``."""
    i = np.arange(len(roots))
    bits = np.zeros((len(roots), -(-len(roots) // WIDTH)), np.uint64)
    bits[i, i // WIDTH] = np.uint64(1) << (i % WIDTH).astype(np.uint64)
    seen, at = np.zeros((len(starts) - 1, bits.shape[1]), np.uint64), roots
    seen[at] = bits
    while len(at):
        yield _bit_counts(bits)[: len(roots)]
        degree = starts[at + 1] - starts[at]
        own = np.repeat(np.arange(len(at)), degree)
        to = nexts[np.arange(len(own)) + np.repeat(starts[at] - (np.cumsum(degree) - degree), degree)]
        order = np.argsort(to)
        to, own = to[order], own[order]
        first = np.flatnonzero(np.diff(to, prepend=-1))
        at = to[first]
        bits = np.bitwise_or.reduceat(bits[own], first, axis=0) if len(first) else bits[:0]
        bits &= ~seen[at]
        new = bits.any(1)
        at, bits = at[new], bits[new]
        seen[at] |= bits


def _bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many rows have each bit: rows of one weight are added three at a time, all bits at once, to sums and carries of twice the weight."""
    total, weight = np.zeros(rows.shape[1] * WIDTH, np.int64), 1
    while len(rows):
        carried = []
        while len(rows) > WIDTH:
            third = len(rows) // 3
            a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
            half = a ^ b
            carried.append((a & b) | (half & c))
            rows = np.concatenate([half ^ c, rows[3 * third :]])
        total += weight * np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        rows, weight = np.concatenate(carried) if carried else rows[:0], 2 * weight
    return total


def _batch_counts(blocks: DataFrame, arcs: DataFrame, tasks: int, backward: bool) -> list[DataFrame]:
    """(root, depth, n), a part for each ``LEVELS`` levels, over some blocks."""
    start = blocks.select("block", F.posexplode("roots").alias("bit", "node")).selectExpr("node", "block", "shiftleft(1L, bit) as seen")
    state = start.repartition(tasks, "block").withColumn("f0", F.col("seen")).persist(StorageLevel.MEMORY_AND_DISK)
    names, depth, counts, rounds = ["f0"], 0, [], 0
    while True:
        counts.append(cut(_counted(Walk(blocks, state, state), state, names, depth, backward)))
        if depth and state.where(f"{names[-1]} <> 0").isEmpty():
            break
        depth += len(names)
        later = state.select("node", "block", "seen", F.col(names[-1]).alias("fresh"))
        names = [f"f{k}" for k in range(LEVELS)]
        for k, name in enumerate(names):
            sent = later.join(arcs, "node").where("own or fresh <> 0").selectExpr(
                "next as node", "block", "if(own, seen, 0L) as seen", "if(own, 0L, fresh) as new", *[f"if(own, {f}, 0L) as {f}" for f in names[:k]]
            )
            met = sent.groupBy("node", "block").agg(*[F.bit_or(c).alias(c) for c in ("seen", "new", *names[:k])])
            later = met.selectExpr("node", "block", "seen | new as seen", *names[:k], f"new & ~seen as {name}").withColumn("fresh", F.col(name))
        before, rounds = state, rounds + 1
        later = later.drop("fresh")
        later = cut(later) if rounds % CUT_EVERY == 0 else later
        state = later.persist(StorageLevel.MEMORY_AND_DISK)
        state.count()
        before.unpersist()
    state.unpersist()
    return counts


def _counted(found: Walk, state: DataFrame, names: list[str], depth: int, backward: bool) -> DataFrame:
    """(root, depth, n) of the bits that are new at each of some levels."""
    if backward:
        sums = state.groupBy("node").agg(*[F.sum(F.bit_count(f)).alias(f) for f in names])
        each = F.array(*[F.struct(F.lit(depth + k).alias("depth"), F.col(f).alias("n")) for k, f in enumerate(names)])
        return sums.select(F.col("node").alias("root"), F.explode(each).alias("c")).select("root", "c.depth", "c.n").where("n > 0")
    each = F.array(*[F.struct(F.lit(depth + k).alias("depth"), F.col(f).alias("bits")) for k, f in enumerate(names)])
    levels = state.select("block", F.explode(each).alias("c")).select("block", "c.bits", "c.depth").where("bits <> 0")
    return found.totals(levels, F.lit(1).cast("long"), "n", "depth").select("root", "depth", "n")


def _least_ancestors(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, color): the least node that leads to each over arcs (a, b), which may be itself."""
    arcs = kept_by(arcs, "a")
    state, n = nodes.selectExpr("node", "node as color", "true as fresh"), 1
    while n:
        for _ in range(HOPS):
            sent = state.where("fresh").selectExpr("node as a", "color").join(arcs, "a").selectExpr("b as node", "null as old", "color")
            met = state.selectExpr("node", "color as old", "color").union(sent).groupBy("node").agg(F.expr("min(color) as color"), F.expr("min(old) as old"))
            state = met.selectExpr("node", "color", "color < old as fresh")
        state, n = cut_counted(state, "fresh")
    arcs.unpersist()
    return state.select("node", "color")


def _leading_back(colors: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, color, found): whether a node leads to the one its color names, over arcs within the color."""
    arcs = kept_by(arcs, "b")
    state, n = colors.selectExpr("node", "color", "node = color as found", "node = color as fresh"), 1
    while n:
        for _ in range(HOPS):
            sent = state.where("fresh").selectExpr("node as b").join(arcs, "b").selectExpr("a as node", "null as color", "false as found", "true as got")
            met = state.selectExpr("node", "color", "found", "false as got").union(sent).groupBy("node")
            met = met.agg(F.expr("max(color) as color"), F.expr("bool_or(found) as found"), F.expr("bool_or(got) as got"))
            state = met.selectExpr("node", "color", "found or got as found", "got and not found as fresh")
        state, n = cut_counted(state, "fresh")
    arcs.unpersist()
    return state.select("node", "color", "found")


def _inside(arcs: DataFrame, nodes: DataFrame, *same: str) -> DataFrame:
    """The arcs whose both ends are among the nodes, and alike in the columns ``same``."""
    ends = [nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in same]) for end in ("a", "b")]
    kept = arcs.join(ends[0], "a").join(ends[1], "b")
    for c in same:
        kept = kept.where(F.col(f"{c}_a") == F.col(f"{c}_b"))
    return kept.select("a", "b")


def components(edges: DataFrame, trims: int = 8) -> DataFrame:
    """(node, component) of every end of an edge (parent_qid, child_qid): the strongly connected component, named by its least node.

    In rounds. First nodes that nothing left leads to, or that lead to nothing left, are components of their own; this is
    repeated up to ``trims`` times. Of the rest, each node takes as its color the least node that leads to it. Nodes of a component
    share a color, and those that lead back to the node of their color are its component. What is left, within the colors, goes into the next
    round; each ends at least one component, and all components that no smaller node leads into end together.
    """
    arcs = cut(edges.select(F.col("parent_qid").alias("a"), F.col("child_qid").alias("b")).dropna().distinct())
    with _rounds(arcs.sparkSession, arcs.count()):
        parts = _components(arcs, trims)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _components(arcs: DataFrame, trims: int) -> list[DataFrame]:
    nodes = cut(arcs.select(F.col("a").alias("node")).union(arcs.select("b")).distinct())
    arcs = arcs.where("a <> b")
    parts = [nodes.limit(0).select("node", F.col("node").alias("component"))]
    while True:
        for _ in range(trims):
            inner = cut(arcs.select(F.col("a").alias("node")).intersect(arcs.select(F.col("b").alias("node"))))
            single = cut(nodes.join(inner, "node", "left_anti"))
            if single.isEmpty():
                break
            parts.append(single.select("node", F.col("node").alias("component")))
            arcs, nodes = cut(_inside(arcs, inner)), inner
        if nodes.isEmpty():
            return parts
        colors = _least_ancestors(nodes, arcs)
        arcs = cut(_inside(arcs, colors, "color"))
        state = _leading_back(colors, arcs)
        parts.append(state.where("found").select("node", F.col("color").alias("component")))
        nodes = cut(state.where(~F.col("found")).select("node"))
        if nodes.isEmpty():
            return parts
        arcs = cut(_inside(arcs, nodes))


def condensed(edges: DataFrame, component: DataFrame) -> DataFrame:
    """(parent_qid, child_qid): the distinct edges between components, without cycles."""
    parent = component.select(F.col("node").alias("parent_qid"), F.col("component").alias("__parent"))
    child = component.select(F.col("node").alias("child_qid"), F.col("component").alias("__child"))
    both = edges.select("parent_qid", "child_qid").join(parent, "parent_qid").join(child, "child_qid").where("__parent <> __child")
    return both.select(F.col("__parent").alias("parent_qid"), F.col("__child").alias("child_qid")).distinct()


def by_component(table: DataFrame, node: str, component: DataFrame) -> DataFrame:
    """The table with its nodes replaced by their components; a node without edges is one of its own."""
    own = component.select(F.col("node").alias(node), F.col("component").alias("__component"))
    rest = [c for c in table.columns if c != node]
    return table.join(own, node, "left").select(F.coalesce("__component", F.col(node)).alias(node), *rest)
