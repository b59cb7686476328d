"""Connected components by alternating large and small stars.

Every round hangs each node's larger neighbours, then its smaller ones, on its
smallest neighbour. The edges stay as many or fewer, rounds grow with the logarithm
of the components' size, and a node of any degree is one key of joins between
written tables, which Spark splits where it is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import keep


def _lowest(edges: DataFrame) -> DataFrame:
    """Of each u of edges (u, v): m, the smallest of u and its neighbours; ``hangs`` on so many smaller ones, ``holds`` larger ones."""
    hangs, holds = F.sum((F.col("v") < F.col("u")).cast("int")).alias("hangs"), F.max(F.col("v") > F.col("u")).alias("holds")
    # Written first, so that the join reads two tables.
    return keep(edges.groupBy("u").agg(F.min("v").alias("m"), hangs, holds).withColumn("m", F.least("u", "m")), "lowest")


def _hang(edges: DataFrame, lowest: DataFrame, only_larger: bool) -> DataFrame:
    """Of edges (u, v): each v to the smallest of u and its neighbours; with ``only_larger``, only v > u."""
    lowest = lowest.select("u", "m")
    joined = edges.join(lowest, "u")
    moved = joined.filter("v > u").select("v", "m") if only_larger else joined.select("v", "m").union(lowest.select(F.col("u").alias("v"), "m"))
    return moved.filter("v <> m").distinct().select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node (links: a, b); the component is its smallest node."""
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        both = edges.union(edges.select("v", "u"))
        lowest = _lowest(both)
        # Done when every node hangs on one other that hangs on none; that one is its smallest neighbour.
        if lowest.filter("hangs > 1 OR (hangs = 1 AND holds)").isEmpty():
            return lowest.select(F.col("u").alias("node"), F.col("m").alias("component"))
        larger = keep(_hang(both, lowest, only_larger=True), "larger")
        edges = keep(_hang(larger, _lowest(larger), only_larger=False), "smaller")
