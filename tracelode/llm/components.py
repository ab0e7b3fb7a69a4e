"""Connected components of a graph given as distinct pairs, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step.  Neighbours are joined to the least of a node's neighbourhood, never collected."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    arcs = both if large else both.filter("v < u")
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = arcs.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("x"), "m")
    else:
        out = joined.select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m"))
    return out.filter("x != m").select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges`` (columns a and b).

    Each round is written to the shared folder, and the loop ends when a round changes
    nothing; the number of rounds grows with the logarithm of the longest path.
    """
    edges = durable(edges.select("a", "b"), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if not now["n"] or now == before:
            break
        before, old = now, edges
        edges = durable(_star(_star(edges, large=True), large=False), "edges")
        discard(old)
    # at the end every edge runs from a root to one of its nodes
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
