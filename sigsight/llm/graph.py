"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsight.session import cut_lineage


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """For each ``u`` its smallest neighbour, at most itself: combined before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); component is the smallest node reachable.

    Alternating stars: each node's larger neighbours move to its smallest
    neighbour, then each node's smaller neighbours do, until only stars around
    the smallest node are left.  Every round is checkpointed to the shared
    folder.  Edges with a null end and loops are ignored.
    """
    both = edges.filter(F.col("u") != F.col("v"))
    edges = cut_lineage(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (now := _signature(edges)) != before:
        before = now
        every = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = every.join(_least_neighbour(every), "u").filter(F.col("v") > F.col("u")) \
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _least_neighbour(large)
        small = large.join(least, "u").filter(F.col("v") != F.col("m")) \
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v")))
                            .filter(F.col("u") != F.col("v")).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
