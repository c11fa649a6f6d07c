"""Jaccard join of documents on word shingles by chosen paths.

Texts with the same shingles are one node. Every run sends each node down a path: at each level a hash function samples
one of its shingles, and nodes that share the sample stay together. A set of nodes is split on until it is small or the
path has ``DEPTH`` levels; nodes with a Jaccard similarity s stay together at a level with probability s. Runs are
repeated until a pair at the threshold, split at every level, is met with probability ``RECALL``.

Small sets are compared by brute force on sketches, which gives groups of candidates. The shingles of those nodes alone
are then gathered, once, and every pair of a group is verified exactly and counted. Sets and groups beyond the size for
one task are dealt out as pairs of chunks; no pair is written out, only a link of each node to the least node it
belongs with and its number of links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut
from tidemark.llm.tables import free_name, slices
from tidemark.llm.tokens import TEXT_AT_ONCE, WordHashes, window_hashes

WORDS, THRESHOLD = 5, 0.8
DEPTH, RECALL = 4, 0.995
SKETCH = 64
MARGIN = 0.25
LEAF, CHUNK = 64, 512
HEAVY = 512


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met in a leaf with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def shingles(words: np.ndarray, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; a shorter text has one shingle of all its words."""
    if not len(words):
        return words
    return np.unique(window_hashes(words, tuple(range(min(width, len(words))))))


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Minimum of each of n hash functions over each set; the sets are not empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), n), np.uint32)
    for i, m in enumerate(_multipliers(n)):
        out[:, i] = np.minimum.reduceat(((flat * m) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _node(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _groups_of(texts: list[str | None], hashes: WordHashes, width: int, most: int = 100_000) -> Iterator[list[np.ndarray]]:
    """Shingle sets of the texts, in lists of about ``most`` shingles."""
    group, size = [], 0
    for text in texts:
        group.append(shingles(hashes.of(text), width))
        size += len(group[-1])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _described(docs: DataFrame, text: str, key: str, runs: int, width: int) -> DataFrame:
    """(key, text_hash, node, path, sketch) of every document; node is null where a text has no word."""
    total = runs * DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (part for whole in batches for part in slices(whole, 1, TEXT_AT_ONCE)):
            nodes, parts, sketches = [], [], []
            for group in _groups_of(batch.column(1).to_pylist(), hashes, width):
                full = [s for s in group if len(s)]
                signed = iter(_signatures(full, total + SKETCH) if full else ())
                for s in group:
                    own = next(signed) if len(s) else None
                    nodes.append(None if own is None else _node(s))
                    parts.append(None if own is None else own[:total].view(np.int32))
                    sketches.append(None if own is None else (own[total:] & 0xFF).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(parts, pa.list_(pa.int32())), pa.array(sketches, pa.binary())],
                [key, "text_hash", "node", "path", "sketch"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text, F.xxhash64(text)).mapInArrow(
        run, f"`{key}` {kind}, text_hash long, node binary, path array<int>, sketch binary"
    )


def _leaves(nodes: DataFrame, runs: int) -> DataFrame:
    """(node, leaf, n): the sets of at least two nodes in which the paths end, with their sizes.

    Sets are counted with partial sums first. Nodes in a very large set go on to the next level without being shuffled
    by it: at most ``HEAVY`` such sets a run can exist, and only their keys are broadcast.
    """
    steps = F.array(*[
        F.struct(F.xxhash64(F.lit(r), F.get("path", F.lit(r * DEPTH))).alias("leaf"), F.slice("path", r * DEPTH + 2, DEPTH - 1).alias("rest"))
        for r in range(runs)
    ])
    rows = cut(nodes.select("node", F.explode(steps).alias("step")).select("node", "step.*"))
    total = rows.count()
    ended = None
    for level in range(DEPTH):
        sizes = cut(rows.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1"))
        many = max(LEAF, total // (HEAVY * runs))
        heavy = sizes.where(F.col("n") > many)
        marked = rows.join(F.broadcast(heavy), "leaf", "left")
        found = marked.where("n is null").drop("n").join(sizes.where(F.col("n") <= many), "leaf")
        found = found.unionByName(marked.where("n is not null"))
        last = level == DEPTH - 1
        here = found if last else found.where(F.col("n") <= LEAF)
        here = here.select("node", "leaf", "n")
        ended = here if ended is None else ended.unionByName(here)
        if not last:
            onward = found.where(F.col("n") > LEAF)
            rows = cut(onward.select("node", F.xxhash64("leaf", F.get("rest", F.lit(0))).alias("leaf"), F.slice("rest", 2, DEPTH).alias("rest")))
    return ended


def _dealt(rows: DataFrame, group: str, size: str, item: str, most: int) -> DataFrame:
    """Adds ``task`` and ``side``: groups of more than ``most`` rows as all pairs of their chunks, each row in each pair it is of.

    In a pair of two chunks the sides are 0 and 1 and only rows of different sides are to be compared; a chunk with
    itself has side 0 alone.
    """
    chunks = F.ceil(F.col(size) / most).cast("int")
    rows = rows.withColumn("__c", F.pmod(F.xxhash64(item), chunks).cast("int"))
    rows = rows.withColumn("__o", F.explode(F.sequence(F.lit(0), chunks - 1)))
    task = F.xxhash64(group, F.least("__c", "__o"), F.greatest("__c", "__o"))
    return rows.select(*[c for c in rows.columns if not c.startswith("__")], task.alias("task"), (F.col("__c") > F.col("__o")).cast("int").alias("side"), (F.col("__c") != F.col("__o")).alias("two"))


def _per_task(rows: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Runs a function over batches that hold whole tasks; a task is never in two batches."""

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            yield from run(pa.Table.from_batches(held)).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            tasks = batch.column("task").to_numpy()
            last = int(np.searchsorted(tasks, tasks[-1], "left"))
            if last == 0 and held and held[-1].column("task")[-1].as_py() == tasks[0]:
                held.append(batch)
                continue
            held.append(batch.slice(0, last))
            held = [b for b in held if b.num_rows]
            if held:
                yield from out()
            held = [batch.slice(last)]
        if held:
            yield from out()

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(cut_batches, schema)


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each member's component, for links between a and b."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _binary(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Fixed-width binary values as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _alike(table: pa.Table, least: float) -> pa.Table:
    """(a, b): each node of a task and the first node that its sketch leads to."""
    tasks, side = table.column("task").to_numpy(), table.column("side").to_numpy()
    two = table.column("two").to_numpy()
    sketch = _binary(table.column("sketch"), SKETCH)
    starts = np.arange(len(tasks))
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    away = 0
    while True:
        away += 1
        starts = starts[starts + away < len(tasks)]
        starts = starts[tasks[starts] == tasks[starts + away]]
        if not len(starts):
            break
        apart = starts[~two[starts] | (side[starts] != side[starts + away])]
        near = apart[(sketch[apart] == sketch[apart + away]).mean(1) >= least]
        left.append(near)
        right.append(near + away)
    label = _least_labels(len(tasks), np.concatenate(left), np.concatenate(right))
    linked = np.flatnonzero(label != np.arange(len(label)))
    node = table.column("node")
    return pa.table({"a": node.take(pa.array(linked)).cast(pa.binary()), "b": node.take(pa.array(label[linked])).cast(pa.binary())})


def _verified(table: pa.Table, threshold: Fraction) -> pa.Table:
    """(a, b, links) of each node that has a link in a task: the least node it belongs with, and the copies it links to."""
    tasks, side = table.column("task").to_numpy(), table.column("side").to_numpy()
    two, copies = table.column("two").to_numpy(), table.column("copies").to_numpy()
    nodes = table.column("node").to_pylist()
    sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
    ends = np.flatnonzero(np.diff(tasks)) + 1
    out_a, out_b, out_n = [], [], []
    for start, end in zip([0, *ends], [*ends, len(tasks)], strict=True):
        members = sorted(range(start, end), key=lambda i: nodes[i])
        if len(members) < 2:
            continue
        sizes = np.array([len(sets[i]) for i in members])
        _, ids = np.unique(np.concatenate([sets[i] for i in members]), return_inverse=True)
        at = np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(int(ids.max()) + 1, np.int64)
        links = np.zeros(len(members), np.int64)
        number, sides = copies[members], side[members]
        left, right = [np.zeros(0, int)], [np.zeros(0, int)]
        for k in range(len(members) - 1):
            mark[ids[at[k] : at[k + 1]]] = 1
            common = np.add.reduceat(mark[ids[at[k + 1] :]], at[k + 1 : -1] - at[k + 1])
            mark[ids[at[k] : at[k + 1]]] = 0
            union = sizes[k] + sizes[k + 1 :] - common
            near = common * threshold.denominator >= union * threshold.numerator
            if two[start]:
                near &= sides[k + 1 :] != sides[k]
            others = np.flatnonzero(near) + k + 1
            links[k] += number[others].sum()
            links[others] += number[k]
            left.append(np.full(len(others), k))
            right.append(others)
        label = _least_labels(len(members), np.concatenate(left), np.concatenate(right))
        for k in np.flatnonzero(links):
            out_a.append(nodes[members[k]])
            out_b.append(nodes[members[label[k]]])
            out_n.append(int(links[k]))
    return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary()), "links": pa.array(out_n, pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component, for edges (a, b); nodes without an edge are not listed.

    In each round every node points to the least of itself and its neighbours, and on to where that one points. Nodes
    with one aim become one, edges between them go, and the rest are made distinct, so that each round has fewer.
    Nodes are digests, in no order along an edge, so rounds are few. They are kept in the checkpoint folder, and so are the
    aims: both sides of the join on them then come straight from a shuffle, so that Spark can split the many nodes of one aim.
    """
    labels = None
    pairs = cut(_ordered(edges, F.col("a"), F.col("b")))
    while labels is None or not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        aim = cut(both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("to")))
        far = aim.select(F.col("a").alias("to"), F.col("to").alias("now"))
        step = cut(aim.join(far, "to").select(F.col("a").alias("node"), "now"))
        if labels is None:
            labels = step.withColumnRenamed("now", "label")
        else:
            moved = step.withColumnRenamed("node", "label")
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("now", "label").alias("label"))
        ends = [step.select(F.col("node").alias(c), F.col("now").alias(f"now_{c}")) for c in ("a", "b")]
        pairs = cut(_ordered(pairs.join(ends[0], "a").join(ends[1], "b"), F.col("now_a"), F.col("now_b")))
    return labels


def _ordered(edges: DataFrame, a: Column, b: Column) -> DataFrame:
    """Distinct edges between different nodes, the lesser first."""
    return edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _classes(docs: DataFrame, text: str, key: str, threshold: float, width: int, recall: float) -> DataFrame:
    """(key, text_hash, class_id, links, n_copies, first_hash): one row per document, as ``join`` says."""
    runs = runs_for(recall, threshold)
    described = cut(_described(docs, text, key, runs, width))
    nodes = described.where("node is not null").groupBy("node").agg(
        F.min(F.struct(key, "text_hash")).alias("rep"), F.count("*").alias("copies"),
        F.first("path").alias("path"), F.first("sketch").alias("sketch"),
    )
    nodes = cut(nodes)
    leaves = cut(_leaves(nodes, runs))
    sketched = leaves.join(nodes.select("node", "sketch"), "node")
    least = threshold - MARGIN
    alike = _per_task(
        _dealt(sketched, "leaf", "n", "node", CHUNK).select("node", "sketch", "task", "side", "two"),
        lambda t: _alike(t, least), "a binary, b binary",
    )
    groups = cut(components(alike))
    sizes = cut(groups.groupBy("label").agg(F.count("*").alias("n")))
    wanted = cut(groups.join(sizes, "label").join(nodes.select("node", "copies", "rep"), "node").select("node", "label", "n", "copies", "rep.*"))
    texts = _texts_of(docs, wanted, text, key, width)
    exact = Fraction(threshold).limit_denominator(10**6)
    found = cut(_per_task(_dealt(texts, "label", "n", "node", CHUNK), lambda t: _verified(t, exact), "a binary, b binary, links long"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = components(found)
    first = nodes.select("node", "copies", F.col(f"rep.{key}").alias("__first"), F.col("rep.text_hash").alias("__hash"))
    joined = first.join(labels.join(links, "node", "left"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_class = cut(joined.where(F.col("links") > 0).groupBy("label").agg(F.min(F.struct("__first", "__hash")).alias("least")))
    named = cut(
        joined.join(by_class, "label", "left").select(
            "node", "copies", F.coalesce("links", F.lit(0)).alias("links"),
            F.coalesce("least", F.struct("__first", "__hash")).alias("least"),
        )
    )
    own = described.select(key, "text_hash", "node")
    return own.join(named, "node", "left").select(
        key, "text_hash",
        F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("least.__first")).alias("class_id"),
        F.when(F.col("node").isNull(), 0).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("links"),
        F.when(F.col("node").isNull(), F.col("text_hash")).otherwise(F.col("least.__hash")).alias("first_hash"),
    )


def _texts_of(docs: DataFrame, wanted: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(node, label, n, copies, shingles) of the wanted nodes, from the one document that stands for each."""
    other = wanted.withColumnRenamed(key, "__key").withColumnRenamed("text_hash", "__hash")
    own = docs.select(key, F.col(text).alias("__text"))
    met = own.join(other, F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64("__text") == F.col("__hash")))
    once = met.groupBy("node", "label", "n", "copies").agg(F.any_value("__text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (part for whole in batches for part in slices(whole, 4, TEXT_AT_ONCE)):
            sets = [shingles(hashes.of(t), width).tobytes() for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary())], ["node", "label", "n", "copies", "shingles"])

    return once.mapInArrow(run, "node binary, label binary, n long, copies long, shingles binary")


def join(
    docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, width: int = WORDS, recall: float = RECALL
) -> DataFrame:
    """(key, class_id, links) of every document.

    Two documents are linked when the Jaccard similarity of their shingles is at least ``threshold``; ``links`` counts
    a document's links, copies included, and ``class_id`` is the least key of all that links connect. Null, empty and
    wordless texts have no shingle, no link and their own key as class. Repeated rows are copies of each other. Other
    columns are not carried. Texts are read whole; one in a script without spaces is few long words.
    """
    return _classes(docs, text, key, threshold, width, recall).select(key, "class_id", "links")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents without near duplicates: of each class the one with the least key stays, with all its columns.

    Of rows that repeat both the key and the text of the one that stays, one stays; documents without words all stay.
    """
    classes = _classes(docs, text, key, THRESHOLD, WORDS, RECALL)
    k, h = free_name(docs, "__key"), free_name(docs, "__hash")
    stays = F.col(key).eqNullSafe(F.col("class_id")) & F.col("text_hash").eqNullSafe(F.col("first_hash"))
    gone = classes.where(~stays).select(F.col(key).alias(k), F.col("text_hash").alias(h)).distinct()
    again = classes.where(stays & (F.col("links") > 0)).groupBy(key, "text_hash").count().where("count > 1")
    repeated = cut(again.select(F.col(key).alias(k), F.col("text_hash").alias(h)))
    same = F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(h))
    kept = docs.join(gone, same, "left_anti")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, same, "left_semi").dropDuplicates([key, text])
    return kept.join(repeated, same, "left_anti").unionByName(once)
