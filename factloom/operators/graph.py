"""Graph views of accepted assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def out_edges(edges: DataFrame, node: str, predicate: str | None = None) -> DataFrame:
    e = edges.where(F.col("subject_id") == node)
    return e if predicate is None else e.where(F.col("predicate") == predicate)


def in_edges(edges: DataFrame, node: str, predicate: str | None = None) -> DataFrame:
    e = edges.where(F.col("object_id") == node)
    return e if predicate is None else e.where(F.col("predicate") == predicate)


def predicate_subgraph(edges: DataFrame, predicate: str) -> DataFrame:
    return edges.where(F.col("predicate") == predicate).select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_out, n_in."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def closure(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst) of all paths of one edge or more, from ``sources(src)`` or everywhere.

    Everywhere: known paths are joined with themselves, so lengths double each round. From
    sources: each round joins the newest pairs with the edges and keeps what is new.
    checkpoint() cuts the lineage, so a lost executor costs a re-read.
    """
    if sources is None:
        known = edges.distinct().checkpoint()
        n = known.count()
        while True:
            far = known.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
            step = known.join(far, "dst").select("src", F.col("far").alias("dst"))
            known = known.unionByName(step).distinct().checkpoint()
            m = known.count()
            if m == n:
                return known
            n = m
    frontier = edges.join(sources, "src", "left_semi")
    known = frontier = frontier.distinct().checkpoint()
    while not frontier.isEmpty():
        step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        frontier = frontier.join(step, "dst").select("src", F.col("far").alias("dst")).distinct().join(known, ["src", "dst"], "left_anti").checkpoint()
        known = known.unionByName(frontier).checkpoint()
    return known


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves; none means the graph is acyclic."""
    return closure(edges).where("src = dst").select(F.col("src").alias("node"))


def simple_cycles(edges: DataFrame, most: int = 8) -> DataFrame:
    """cycle: the nodes of each simple cycle of up to ``most`` edges, once, from its least node on.

    Paths start at every node and go through greater ones only, an edge a round; where an edge leads
    back to the start, a cycle is found. Edges that no cycle can have (nothing leads to their
    source, or nothing on from their target) are dropped first. The number of paths may grow with each
    round, as that of cycles does; they are rows of a table, in no group.
    """
    e = edges.select("src", "dst").distinct()
    loops = e.where("src = dst").select(F.array("src").alias("cycle"))
    e = e.where("src <> dst")
    for _ in range(3):
        e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").checkpoint()
    found, paths = loops, e.where("dst > src").select(F.array("src", "dst").alias("path"), F.col("dst").alias("src"))
    for _ in range(most - 1):
        step = paths.join(e, "src").where((F.col("dst") >= F.get("path", F.lit(0))) & ((F.col("dst") == F.get("path", F.lit(0))) | ~F.array_contains("path", F.col("dst")))).checkpoint()
        found = found.unionByName(step.where(F.col("dst") == F.get("path", F.lit(0))).select(F.col("path").alias("cycle")))
        paths = step.where(F.col("dst") > F.get("path", F.lit(0))).select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("src"))
        if paths.isEmpty():
            break
    return found


def would_close_cycle(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates(src, dst) that are loops or whose target already reaches their source."""
    paths = closure(edges, candidates.select(F.col("dst").alias("src")).distinct())
    back = paths.select(F.col("src").alias("dst"), F.col("dst").alias("src")).distinct().withColumn("path", F.lit(True))
    return candidates.join(back, ["src", "dst"], "left").where("src = dst or path").select("src", "dst")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the weakly connected components of edges(a, b): comp is the smallest node.

    Large-star and small-star in turns, each an aggregate and a join, until every node points at
    one root and no root points on.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    while True:
        flip = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        label = e.unionByName(e.select(F.col("v").alias("u"), "v")).groupBy("u").agg(F.min("v").alias("comp"), F.max("v").alias("top"))
        if label.where("comp <> top").isEmpty():
            return label.select(F.col("u").alias("node"), "comp")
        low = e.unionByName(flip).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("far")).join(low, "u").select(F.col("far").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = small.where("u <> v").distinct().checkpoint()
