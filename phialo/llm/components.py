"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phialo import scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest one: a row for each edge at most."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node u and its smaller neighbours v are tied to the smallest one."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node either has one edge down or only edges up: then all end at their least node."""
    down, root = F.sum("down"), F.max("root")
    nodes = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("root"))
    nodes = nodes.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("root")))
    return (nodes.groupBy("node").agg((down + root).alias("roles")).agg(F.max("roles")).first()[0] or 0) <= 1


def components(edges: DataFrame) -> DataFrame:
    """Stored (node, component) for every node of ``edges`` (u, v); the component is its least node.

    A round keeps components and lowers edges, until they are stars around least nodes.  Each
    round's edges are a stored table, so a lost executor costs one round at most; a round's
    table goes once the next one is there.
    """
    lowered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    state = scratch.table(lowered.distinct(), "edges")
    while not _stars(state):
        before, state = state, scratch.table(_small_star(_large_star(state)), "edges")
        scratch.drop(before)
    down = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    labels = scratch.table(down.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "labels")
    scratch.drop(state)
    return labels
