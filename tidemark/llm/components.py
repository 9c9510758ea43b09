"""Connected components by alternating star contractions, on edges as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them. Edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    down = edges.join(least, "b")
    return down.select(F.col("m").alias("a"), F.col("a").alias("x")).unionByName(least.select(F.col("m").alias("a"), F.col("b").alias("x"))).where("a <> x").select("a", F.col("x").alias("b")).distinct()


def _digest(edges: DataFrame) -> tuple:
    """Count and checksums that tell whether a round changed anything."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of the undirected ``edges (a, b)``; a component is named by its least node.

    Loops and repeated edges count for nothing; nodes without edges aren't returned.  A node
    with very many neighbours is joined, never gathered: AQE can split it.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (now := _digest(edges)) != before:
        if not now[0]:
            break
        before, edges = now, stored(_small_star(_large_star(edges)), "edges")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
