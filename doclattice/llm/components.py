"""Connected components by alternating large-star and small-star steps over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star links greater neighbours to the least neighbour, small star the others."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")) if large else both.groupBy("u").agg(F.min("v").alias("m"))
    near = both.join(least, "u")
    if large:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) to stars (u, v) with v the least node of u's component; the least node itself has no row.

    Every step is written to the shared folder, so lineage stays short and lost executors cost one step; the tables of the
    step before are removed then. Stars are a fixed point of both steps.
    """
    edges = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = None
    while True:
        large = stash(_star(edges, True), "cc")
        small = stash(_star(large, False), "cc")
        discard(edges, large)
        edges, now = small, _print(small)
        if now == seen or not now[0]:
            return edges
        seen = now
