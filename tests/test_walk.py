"""Walks of many roots at once and components, against plain code."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import graph, views, walk


def edge_frame(spark, edges):
    return spark.createDataFrame(list(edges), "parent_qid long, child_qid long")


def root_frame(spark, roots):
    return spark.createDataFrame([(r,) for r in roots], "root long")


def reach(edges, root, max_depth=None):
    below = {}
    for a, b in edges:
        below.setdefault(a, set()).add(b)
    depth, level = {root: 0}, [root]
    while level and (max_depth is None or depth[level[0]] < max_depth):
        level = list(dict.fromkeys(b for a in level for b in below.get(a, ()) if b not in depth))
        depth.update((b, len_ + 1) for b, len_ in zip(level, [max(depth.values())] * len(level)))
    return depth


def cyclic(seed, nodes=170, ring=10):
    """A long ring, chains into and out of it, smaller rings, random edges, loops and repeated edges."""
    pick = random.Random(seed)
    edges = [(i, (i + 1) % ring) for i in range(ring)] + [(100 + i, 101 + i) for i in range(4)] + [(104, 0), (5, 130)] + [(130 + i, 131 + i) for i in range(3)]
    edges += [(150, 151), (151, 152), (152, 150), (160, 160), (3, 4), (3, 4)]
    return edges + [(pick.randrange(nodes), pick.randrange(nodes)) for _ in range(80)]


def ringed(seed):
    """80 nodes: two rings, one behind the other, a loop, and random edges from smaller to greater nodes."""
    pick = random.Random(seed)
    edges = [(i, (i + 1) % 8) for i in range(8)] + [(20 + i, 20 + (i + 1) % 5) for i in range(5)] + [(7, 21), (24, 40), (33, 33), (10, 2), (10, 2)]
    return edges + [tuple(sorted(pick.sample(range(30, 80), 2))) for _ in range(25)]


@pytest.mark.parametrize("depth", (None, 5))
def test_a_walk_of_many_roots_equals_one_by_one(spark, depth):
    edges, roots = cyclic(1), [*range(0, 170, 2), 999]
    found = walk.walk(root_frame(spark, [*roots, roots[0], None]), edge_frame(spark, edges), depth)
    expected = sorted((r, n, d) for r in roots for n, d in reach(edges, r, depth).items())
    assert sorted(map(tuple, found.by_root(found.levels).select("root", "node", "depth").collect())) == expected
    assert sorted(map(tuple, found.by_root(found.reached).select("root", "node").collect())) == [(r, n) for r, n, _ in expected]
    nodes, blocks = len({x for e in edges for x in e} | set(roots)), found.blocks.count()
    assert max(n for _, n in rows(found.levels.groupBy("depth").count())) <= nodes * blocks
    assert blocks == 2 and found.reached.count() * 3 < len({(r, n) for r, n, _ in expected}) or depth  # rows kept, against those of a walk root by root


def test_sums_by_root_and_depths_equal_plain_code(spark):
    edges = cyclic(2)
    roots = list(range(170))
    categories = spark.createDataFrame([(q,) for q in roots], "qid long")
    found = {(r["root"], r["depth"]): r["n"] for r in graph.depth_histogram(root_frame(spark, [*roots, 5000]), categories, edge_frame(spark, edges)).collect()}
    expected = {}
    for r in roots:
        for d in reach(edges, r).values():
            expected[r, d] = expected.get((r, d), 0) + 1
    assert found == expected
    stats = {r["root"]: r for r in graph.category_depth_stats(root_frame(spark, [7, 5000]), categories, edge_frame(spark, edges)).collect()}
    own = reach(edges, 7)
    assert (stats[7]["max_depth"], stats[7]["reached"], stats[7]["unreachable"]) == (max(own.values()), len(own), 170 - len(own))
    assert stats[7]["average_depth"] == pytest.approx(sum(own.values()) / len(own))
    assert tuple(stats[5000]) == (5000, 0, 0.0, 0, 0)
    pairs = [(a, a % 170) for a in range(300)] + [(a, (a + 7) % 170) for a in range(0, 300, 3)]
    daily = spark.createDataFrame([(a, "2032-01-05", a + 1) for a in range(0, 300, 2)], "article_qid long, date string, views long").withColumn("date", F.to_date("date"))
    totals = views.category_rollup_totals(categories, edge_frame(spark, edges), spark.createDataFrame(pairs, "article_qid long, category_qid long"), daily, 4, "2032-01-01", "2032-01-31")
    expected = {}
    for r in roots:
        own = reach(edges, r, 4)
        below = {a for a, c in pairs if c in own and a % 2 == 0}
        if below:
            expected[r] = sum(a + 1 for a in below)
    assert {r["root"]: r["total_views"] for r in totals.collect()} == expected


def plain_components(edges):
    nodes = {x for e in edges if None not in e for x in e}
    below = {n: set(reach([e for e in edges if None not in e], n)) for n in nodes}
    return sorted((n, min(m for m in below[n] if n in below[m])) for n in nodes)


@pytest.mark.parametrize("trims", (8, 0))
def test_components_equal_plain_code(spark, trims):
    edges = [*ringed(3), (None, 3), (3, None)]
    assert sorted(map(tuple, walk.components(edge_frame(spark, edges), trims).collect())) == plain_components(edges)


def test_components_of_no_edges_and_of_a_chain(spark):
    assert walk.components(edge_frame(spark, [])).collect() == []
    assert sorted(map(tuple, walk.components(edge_frame(spark, [(3, 2), (2, 1)])).collect())) == [(1, 1), (2, 2), (3, 3)]


def test_articles_below_a_cycle_are_walked_once(spark, monkeypatch):
    edges = ringed(5)
    roots = list(range(80))
    categories = spark.createDataFrame([(q,) for q in range(78)], "qid long")
    pairs = [(1000 + a, a % 80) for a in range(200)]
    walked = []

    def counted(*asked):
        found = walk.walk(*asked)
        walked.append(found.levels.count())
        return found

    monkeypatch.setattr(graph, "walk", counted)
    expected = sorted((r, a) for r in range(78) for a, c in pairs if c in reach(edges, r))
    found = []
    for width in (64, 10_000):  # condensed, and not
        monkeypatch.setattr(graph, "WIDTH", width)
        found.append(graph.articles_in_category(root_frame(spark, roots), categories, edge_frame(spark, edges), spark.createDataFrame(pairs, "article_qid long, category_qid long"), None))
    assert [sorted(map(tuple, f.collect())) for f in found] == [expected, expected]
    assert walked[0] * 2 < walked[1]


def test_a_short_walk_is_one_plan(spark):
    edges = edge_frame(spark, cyclic(6))
    spark.sparkContext.setJobGroup("short-walk", "")
    found = graph.descend(root_frame(spark, range(40)), edges, graph.PLANNED_DEPTH)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("short-walk")) == []
    expected = sorted((r, n, d) for r in range(40) for n, d in reach(cyclic(6), r, graph.PLANNED_DEPTH).items())
    assert sorted(map(tuple, found.select("root", "node", "depth").collect())) == expected
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_trend_joins_nothing_after_its_sums(spark):
    mask = spark.createDataFrame([(1, 5)], "root long, article_qid long")
    daily = spark.createDataFrame([(5, 3)], "article_qid long, views long").withColumn("date", F.lit("2032-01-02").cast("date"))
    found = views.masked_trend(mask, daily, "2032-01-01", "2032-01-03")
    logical = found._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("Join") == 1 and logical.index("Aggregate") < logical.index("Join")
    assert [(r["root"], r["date"].day, r["views"]) for r in found.orderBy("date").collect()] == [(1, 1, 0), (1, 2, 3), (1, 3, 0)]


@pytest.mark.parametrize("few", (False, True))
def test_depths_are_counted_in_batches_and_either_way(spark, monkeypatch, few):
    edges = [*cyclic(3, 140), *((200 + i, 201 + i) for i in range(12))]
    nodes = sorted({x for e in edges for x in e})
    roots = [*(nodes[::5] if few else nodes[::1]), 999]
    monkeypatch.setattr(walk, "BATCH", 200)
    monkeypatch.setattr(walk, "CUT_EVERY", 2)
    kept = []
    counted = walk._counted
    monkeypatch.setattr(walk, "_counted", lambda found, state, *rest: kept.append(state.count()) or counted(found, state, *rest))
    found = walk.depth_counts(root_frame(spark, [*roots, roots[0], None]), edge_frame(spark, edges))
    expected = sorted((r, d, n) for r in roots for d, n in Counter(reach(edges, r).values()).items())
    assert sorted(map(tuple, found.collect())) == expected
    assert max(kept) <= (len(nodes) + 1) * 3  # rows at a time: nodes and the blocks of a batch


def test_what_is_told_apart_is_written_in_few_bytes(spark, tmp_path):
    blocks = spark.createDataFrame([(0, [1])], "block long, roots array<long>")
    table = spark.range(160).selectExpr("id + 7 as article_qid", "0L as block", "1L as bits")
    named = spark.range(20_000).selectExpr("id * 3 as root", "1L as node")
    settings = {"spark.sql.shuffle.partitions": "1", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # few tasks and, as with larger tables, no broadcast
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        walk.Walk(blocks, table, table).by_member(table, named, "article_qid").write.parquet(f"{tmp_path}/out")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.count() == found.distinct().count() == 160 * 20_000
    assert tuple(found.selectExpr("min(root)", "max(root)", "min(article_qid)", "max(article_qid)").first()) == (0, 59_997, 7, 166)
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 160 * 20_000


@pytest.mark.parametrize("few", (False, True))
def test_depths_of_a_graph_of_bounded_size_are_counted_where_the_roots_are(spark, monkeypatch, few):
    edges = [*cyclic(4, 400), *((500 + i, 501 + i) for i in range(12)), *((600, 601 + i) for i in range(70)), *((601 + i, 600) for i in range(70)), (None, 3), (3, None)]
    nodes = sorted({x for e in edges for x in e if x is not None})
    roots = [*(nodes[::7] if few else nodes), 999]
    monkeypatch.setattr(walk, "BATCH", 4 * len(edges) * 2)
    monkeypatch.setattr(walk, "WORDS", 2)
    monkeypatch.setattr(walk, "_batch_counts", None)  # no level is a job
    found = walk.depth_counts(root_frame(spark, [*roots, roots[0], None]), edge_frame(spark, edges))
    expected = sorted((r, d, n) for r in roots for d, n in Counter(reach([e for e in edges if None not in e], r).values()).items())
    assert sorted(map(tuple, found.select("root", "depth", "n").collect())) == expected
    none = walk.depth_counts(root_frame(spark, [4, 5]), edge_frame(spark, []))
    assert sorted(map(tuple, none.collect())) == [(4, 0, 1), (5, 0, 1)]


def test_bits_of_many_rows_are_counted_whole():
    rows = np.random.default_rng(5).integers(0, 2**63, (1000, 3), np.uint64)
    assert walk._bit_counts(rows).tolist() == [sum(int(w) >> i & 1 for w in rows[:, k]) for k in range(3) for i in range(64)]


def test_depth_stats_of_a_bounded_graph_walk_in_tasks(spark, monkeypatch):
    edges, roots = [*cyclic(7), *((300 + i, 301 + i) for i in range(40))], list(range(0, 340, 3))
    categories = spark.createDataFrame([(q,) for q in range(341)], "qid long")
    monkeypatch.setattr(walk, "_batch_counts", None)  # no level is a job
    stats = graph.category_depth_stats(root_frame(spark, [*roots, 5000]), categories, edge_frame(spark, edges))
    expected = {r: (max(d), sum(d) / len(d), len(d), 341 - len(d)) for r in roots for d in [list(reach(edges, r).values())]} | {5000: (0, 0.0, 0, 0)}
    assert {r["root"]: tuple(r)[1:] for r in stats.collect()} == expected
