"""Connected components of an edge table by alternating star contraction; nothing but the count of changes reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Point each node's larger (``both``) or smaller neighbours, and the node itself, at the smallest of them all."""
    flipped = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    pairs = flipped.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))) if both else flipped
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = pairs.join(least, "u")
    moved = joined.filter("v > u" if both else "v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    if both:
        return moved.filter("a <> b").distinct()
    return moved.unionByName(least.filter("u <> m").select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, label`` of every node of ``edges`` (``a, b`` integers): the label is the component's smallest node.

    Fails when ``rounds`` don't suffice (they grow with the logarithm of the longest chain)."""
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    now, mark = stored(ordered, "edges"), None
    for _ in range(rounds):
        now = stored(_star(_star(now, True), False), "edges")
        told = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_if(F.col("a") > F.col("b"))).first()
        if told == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
                now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
        mark = told
    raise RuntimeError(f"components not settled after {rounds} rounds")
