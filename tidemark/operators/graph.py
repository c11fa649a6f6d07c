"""Walks over the category graph. Every operator takes a frame of keys: one row is one question, all run in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut
from tidemark.operators.walk import WIDTH, Walk, by_component, components, condensed, depth_counts, walk

PLANNED_DEPTH = 3
"""Walks of up to so many levels are joins in one plan."""


def descend(roots: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth): every category reached from each root over child edges, at its least depth; roots at 0.

    To ``PLANNED_DEPTH`` the levels are chained joins of one lazy plan, without jobs of their own. Deeper walks go level by level, 64
    roots a number, and tell the roots apart at the end.
    """
    if max_depth is not None and max_depth <= PLANNED_DEPTH:
        return _planned(roots, edges, max_depth)
    found = walk(roots, edges, max_depth)
    return found.by_root(found.levels).select("root", "node", "depth")


def _planned(roots: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """The walk as one plan: a level is a join of the one before; the least depth of a node counts.

    Nodes met on several paths are put together where a further level would multiply them, and at the end.
    """
    steps = edges.select(F.col("parent_qid").alias("node"), F.col("child_qid").alias("next"))
    level = roots.select("root", F.col("root").alias("node")).where("root is not null").distinct()
    found = level.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        level = level.join(steps, "node").select("root", F.col("next").alias("node"))
        level = level.distinct() if 1 < depth < max_depth else level
        found = found.unionByName(level.withColumn("depth", F.lit(depth)))
    return found.groupBy("root", "node").agg(F.min("depth").alias("depth")) if max_depth else found


def known_roots(roots: DataFrame, categories: DataFrame) -> DataFrame:
    return roots.select("root").distinct().join(categories.select(F.col("qid").alias("root")), "root", "left_semi")


def articles_in_category(roots: DataFrame, categories: DataFrame, edges: DataFrame, pairs: DataFrame, max_depth: int | None) -> DataFrame:
    """(root, article_qid): the articles of each root and of what is below it to ``max_depth``, each once.

    A root that is no known category has none. Depth 0 needs no walk. Without a depth, all members of a cycle have the same
    articles: for more than ``WIDTH`` roots the graph is condensed to its components first and walked once for each component
    that has a root; what is found is spread to the roots.
    """
    start = known_roots(roots, categories)
    members = pairs.select(F.col("category_qid").alias("node"), "article_qid")
    if max_depth is not None and max_depth <= PLANNED_DEPTH:
        reached = start.select("root", F.col("root").alias("node")) if max_depth == 0 else descend(start, edges, max_depth)
        return reached.select("root", "node").join(members, "node").select("root", "article_qid").distinct()
    if max_depth is not None or start.limit(WIDTH + 1).count() <= WIDTH:
        found, bits = article_bits(start, edges, members, max_depth)
        return found.by_root(bits)
    component = components(edges)
    named = cut(by_component(start.withColumn("node", F.col("root")), "node", component))
    found, bits = article_bits(named.select(F.col("node").alias("root")), condensed(edges, component), by_component(members, "node", component), None)
    return found.by_member(bits, named, "article_qid", members.agg(F.approx_count_distinct("article_qid")).first()[0])


def article_bits(roots: DataFrame, edges: DataFrame, members: DataFrame, max_depth: int | None) -> tuple[Walk, DataFrame]:
    """The walk, and (article_qid, block, bits): the roots that each article lies below; ``members`` are (node, article_qid)."""
    found = walk(roots, edges, max_depth)
    return found, found.reached.join(members, "node").groupBy("article_qid", "block").agg(F.bit_or("bits").alias("bits"))


def child_categories(parents: DataFrame, edges: DataFrame) -> DataFrame:
    """(parent_qid, child_qid) of the asked parents; repeated edges stay."""
    return edges.join(parents.select("parent_qid").distinct(), "parent_qid", "left_semi").select("parent_qid", "child_qid")


def parent_categories(children: DataFrame, edges: DataFrame) -> DataFrame:
    """(child_qid, parent_qid) of the asked children."""
    return edges.join(children.select("child_qid").distinct(), "child_qid", "left_semi").select("child_qid", "parent_qid")


def descendant_categories(roots: DataFrame, categories: DataFrame, edges: DataFrame, max_depth: int | None) -> DataFrame:
    """(root, qid, depth) of all below each root, the root itself left out."""
    found = descend(known_roots(roots, categories), edges, max_depth)
    return found.where("depth > 0").select("root", F.col("node").alias("qid"), "depth")


def article_categories(articles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(article_qid, category_qid) of the asked articles; an unknown article has none."""
    return pairs.join(articles.select("article_qid").distinct(), "article_qid", "left_semi").select("article_qid", "category_qid")


def exists(asked: DataFrame, dimension: DataFrame) -> DataFrame:
    """(qid, exists) of the asked qids, for articles or categories."""
    known = dimension.select("qid").distinct().withColumn("exists", F.lit(True))
    return asked.select("qid").distinct().join(known, "qid", "left").select("qid", F.coalesce("exists", F.lit(False)).alias("exists"))


def category_depth_stats(roots: DataFrame, categories: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, max_depth, average_depth, reached, unreachable) over all that each root reaches, itself included.

    An unknown root has zeros.
    """
    counts = depth_histogram(roots, categories, edges)
    stats = counts.groupBy("root").agg(
        F.max("depth").alias("max_depth"), (F.sum(F.col("depth") * F.col("n")) / F.sum("n")).alias("average_depth"), F.sum("n").alias("reached")
    )
    total = categories.agg(F.countDistinct("qid").alias("total"))
    full = roots.select("root").distinct().join(stats, "root", "left").join(F.broadcast(total))
    return full.select(
        "root", F.coalesce("max_depth", F.lit(0)).alias("max_depth"), F.coalesce("average_depth", F.lit(0.0)).alias("average_depth"),
        F.coalesce("reached", F.lit(0)).alias("reached"),
        F.when(F.col("reached").isNull(), 0).otherwise(F.col("total") - F.col("reached")).alias("unreachable"),
    )


def depth_histogram(roots: DataFrame, categories: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, depth, n): how many categories lie at each depth, counted bit by bit without a row for a root and a category."""
    return depth_counts(known_roots(roots, categories), edges)


def sub_category_counts(edges: DataFrame) -> DataFrame:
    """(parent_qid, child_count) of distinct children."""
    return edges.distinct().groupBy("parent_qid").agg(F.count("*").alias("child_count"))


def sub_categories_counted(parents: DataFrame, edges: DataFrame, categories: DataFrame) -> DataFrame:
    """(parent_qid, qid, title, child_count, total_count): the distinct children of the asked parents.

    ``title`` is null where the edition has none, ``child_count`` is the number of a child's own children, ``total_count``
    that of all the parent's children.
    """
    below = child_categories(parents, edges).distinct()
    counts = sub_category_counts(edges.select("parent_qid", "child_qid"))
    total = below.groupBy("parent_qid").agg(F.count("*").alias("total_count"))
    own = counts.select(F.col("parent_qid").alias("qid"), "child_count")
    titles = categories.groupBy("qid").agg(F.min_by("page_title", "page_id").alias("title"))
    return (
        below.select("parent_qid", F.col("child_qid").alias("qid")).join(titles, "qid", "left").join(own, "qid", "left").join(total, "parent_qid")
        .select("parent_qid", "qid", "title", F.coalesce("child_count", F.lit(0)).alias("child_count"), "total_count")
    )
