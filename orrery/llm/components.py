"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.scratch import Scratch

#: Nodes with more edges than this, and than a MOST_HUBS-th of all, are hubs.
HUB, MOST_HUBS = 1_000, 10_000


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of an edge, component being its smallest node.

    ``edges`` has two columns of one orderable type; direction, loops and repeats do
    not matter, and edges with a null end are left out. Alternates large-star and
    small-star steps (Kiveris et al., 2014) until every component is a star around its
    smallest node: each is a minimum per node with map-side partial aggregates and an
    equi-join. The minima of hubs, of which there are MOST_HUBS at most, are broadcast,
    so a hub's edges stay where they are. Every round is written out; the rounds grow
    with the logarithm of the longest path. Three queries a round without hubs: each
    query takes threads, plans and compiled code of the driver.
    """
    a, b = edges.columns
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = scratch.save(e)
    count, degree, up, stars = _shape(e)
    while not stars:
        both = _with_least(e.union(e.select("v", "u")), 2 * count, degree, scratch).withColumn("m", F.least("u", "m"))
        large = scratch.save(both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        # an edge of large comes from a smaller neighbour of its u, and there are `up` of these at most
        small = _with_least(large, count, up, scratch).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        following = scratch.save(small.where("u != v").distinct())
        scratch.drop(e)
        e = following
        count, degree, up, stars = _shape(e)
        scratch.drop(large)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def _with_least(e: DataFrame, count: int, degree: int, scratch: Scratch) -> DataFrame:
    """Edges (u, v), of which there are ``count`` at most and ``degree`` at most of one u, with m, the smallest v of their u."""
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    most = max(HUB, count // MOST_HUBS)
    if degree <= most:
        return e.join(low.drop("n"), "u")
    hubs = scratch.save(low.where(F.col("n") > most).drop("n"))  # fewer than count / most rows
    rest = e.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(low.where(F.col("n") <= most).drop("n"), "u")
    return rest.union(e.join(F.broadcast(hubs), "u"))


def _shape(e: DataFrame) -> tuple[int, int, int, bool]:
    """Of distinct edges u > v: how many, the most of a node, the most of a node to smaller ones, and whether they are stars around their smallest nodes."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    got = nodes.agg(F.sum("up"), F.max(F.col("up") + F.col("down")), F.max("up"), F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return got[0] or 0, got[1] or 0, got[2] or 0, not got[3]
