"""Connected components by alternating large-star and small-star steps; every node ends next to its smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, hub_join

#: A node is a hub from so many edges on, and from this share of all edges on: so there are at most 2 / SHARE hubs.
LEAST_HUB, SHARE = 64, 1e-3


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(rows: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """``rows`` (a, b) with ``m`` of their node ``a`` from the written table ``least`` (a, m, n).

    A hub's rows stay where they are and meet a broadcast of the hubs, at most 2 / ``SHARE`` of them; only the other
    nodes' rows are dealt out by node, so no task gets the rows of a hub.
    """
    hub = F.col("n") > max(LEAST_HUB, int(n_edges * SHARE))
    some = least.where(hub).limit(1).count()
    return (hub_join(rows, least, "a", hub) if some else rows.join(least, "a")).select("a", "b", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node reachable. Null ends link nothing.

    Each step is a min per node (summed before the shuffle) and a join on the node, with hubs apart. Steps end when the
    edges are stars; their number grows with the logarithm of the longest chain. A step's tables go after the next.
    """
    spark = edges.sparkSession
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    count = lambda: edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    now, before = count(), None
    while now != before:
        both = _both_ways(edges)
        near = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = _with_least(both.where("b > a"), near, now["n"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = cut(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        least = cut(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        joined = _with_least(down, least, now["n"])
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        old, edges = edges, cut(small.where("a <> b").distinct())
        before, now = now, count()
        discard(spark, old, near, down, least)
    nodes = edges.groupBy("a").agg(F.min("b").alias("label"))
    roots = edges.select("b").distinct()
    labels = cut(nodes.select(F.col("a").alias("node"), "label").union(roots.select(F.col("b").alias("node"), F.col("b").alias("label"))))
    discard(spark, edges)
    return labels
