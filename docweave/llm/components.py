"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import stash


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u goes to the smallest of u and its neighbours."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = stash(both.groupBy("u").agg(F.min("v").alias("m")), "star")
    return (both.where("v > u").join(least, "u")
            .select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its neighbours below u go to the smallest of them."""
    least = stash(edges.groupBy("hi").agg(F.min("lo").alias("m")), "star")
    moved = (edges.join(least, "hi").where("lo <> m")
             .select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; ``edges``: (a, b) longs.

    Component: the smallest node reachable.  Rows with a null end or equal ends
    are no edges.  The loop ends when a round changes nothing (the number of
    rounds grows with the logarithm of the longest path); only a count and a
    checksum reach the driver.  A node with very many edges is safe: minima are
    pre-aggregated, and the joins back are plain joins that AQE can split.
    """
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"),
                                             F.least("a", "b").alias("lo")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = stash(_small_star(stash(_large_star(now), "edges")), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
