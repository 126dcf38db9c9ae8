"""Connected components by alternating large and small stars, with settled tables between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b. Every node u links its larger (large) or its smaller neighbours and itself to the smallest of all."""
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    sides = down.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else down
    least = settled(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    if large:
        moved = sides.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = sides.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return settled(moved.where("a > b").distinct())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node in reach, for every node with an edge to another one.

    Nulls and edges of a node with itself are left out; repeated edges and either direction count once. The number of
    rounds grows with the logarithm of a component's diameter; a round's rows are at most twice the edges.
    """
    edges = settled(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct())
    before = None
    while True:
        edges = _stars(_stars(edges, large=True), large=False)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now


def largest_component(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges of the largest component (ties: the one with the smallest node), as (source, target), source < target.

    Labels are trimmed and upper-cased first, so edges that only differ in that are one.
    """
    tidy = edges.select(F.upper(F.trim(a)).alias("x"), F.upper(F.trim(b)).alias("y")).select(F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target")).distinct()
    labels = settled(components(tidy, "source", "target"))
    best = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = labels.join(F.broadcast(best), "component", "left_semi").select(F.col("node").alias("source"))
    return tidy.join(inside, "source", "left_semi")
