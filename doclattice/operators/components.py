"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import written


def roots(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs to (node, root): the least node of every node's component.

    Each round hangs every node under the least node that it or a neighbour knows, then jumps to the root of that root;
    rounds are written, and end when nothing changes. About the logarithm of the longest path of them are needed.
    """
    both = written(edges.where("u <> v").select("u", "v").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    if both.isEmpty():
        return both.select(F.col("u").alias("node"), F.col("v").alias("root"))
    known = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("root")))
    while True:
        near = both.join(known, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("least"))
        lower = known.join(near, F.col("node") == F.col("u")).select("node", F.least("root", "least").alias("root"), F.col("root").alias("old"))
        # the old root learns of the lower one too, so that whole trees move
        hooks = lower.where("root < old").groupBy(F.col("old").alias("h")).agg(F.min("root").alias("hook"))
        moved = lower.join(hooks, F.col("node") == F.col("h"), "left").select("node", F.least("root", F.coalesce("hook", "root")).alias("root"), "old")
        moved = written(moved)
        jump = moved.select(F.col("node").alias("j"), F.col("root").alias("up"))
        after = written(moved.join(jump, F.col("root") == F.col("j")).select("node", F.least("root", "up").alias("root"), "old"))
        if not after.where("root < old").limit(1).count():
            return after.select("node", "root")
        known = after.select("node", "root")
