"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.plans.skew import join_facts
from harvestry.sources.shared import materialize


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour. Hubs are hot keys, and joined as such."""
    both = _neighbours(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hung = join_facts(both.filter("v > u"), least, "u", 2 * total, F.xxhash64("v"))
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_facts(down, least, "u", 2 * total, F.xxhash64("v")).filter("v <> m")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge, ``component`` being the least node of its component.

    Nodes are longs. Self-loops and edges with a null end are ignored, repeated edges count once; no edges
    give no rows. Every round is written to the shared folder, and only a row count and a checksum reach the
    driver. Rounds grow with the logarithm of the longest path.
    """
    now = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).filter("u <> v").distinct()
    now, seen = materialize(now, "edges"), None
    for _ in range(max_rounds):
        mark = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        now = materialize(_small_star(_large_star(now, mark[0]), mark[0]), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)


def joined_components(components: DataFrame, links: DataFrame, src: str, dst: str) -> DataFrame:
    """``components``, ``(node, component)`` of :func:`connected_components`, after more links: only components that these join are worked on again."""
    named = components.withColumnsRenamed({"node": "_node", "component": "_own"})
    ends = links.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v"))
    for c in ("u", "v"):
        ends = ends.join(named, F.col(c) == F.col("_node"), "left").withColumn(c, F.coalesce("_own", c)).drop("_node", "_own")
    edges = materialize(ends.filter("u <> v").distinct(), "edges")
    if edges.isEmpty():
        return components
    tops = materialize(connected_components(edges, "u", "v"), "components")
    moved = tops.select(F.col("node").alias("_node"), F.col("component").alias("_top"))
    held = components.join(moved, F.col("component") == F.col("_node"), "left").select("node", F.coalesce("_top", "component").alias("component"))
    return held.unionByName(tops.join(components.select("node"), "node", "left_anti"))
