"""Connected components of a distributed graph, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import stored


def roots(edges: DataFrame) -> DataFrame:
    """node, root (the least node it is connected with) of all nodes of edges (a, b: long).

    Each round lets every root that has a lesser neighbour hook on to the least, then
    shortens the chains of hooks by joining them with themselves; all of it in joins
    and map-side combined aggregates over tables in the shared folder.
    """
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = stored(ends.select("node", F.col("node").alias("root")), "labels")
    between = stored(edges.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).filter("high != low").distinct(), "edges")
    while True:
        hooks = stored(between.groupBy(F.col("high").alias("old")).agg(F.min("low").alias("new")), "hooks")
        if hooks.isEmpty():
            return labels
        while True:  # the chains old -> new -> newer
            far = hooks.select(F.col("old").alias("new"), F.col("new").alias("newer"))
            jumped = stored(hooks.join(far, "new", "left").select("old", F.coalesce("newer", "new").alias("new"), F.col("newer").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("old", "new")
            if jumped.filter("moved").isEmpty():
                break
        labels = stored(labels.join(hooks, labels["root"] == hooks["old"], "left").select("node", F.coalesce("new", "root").alias("root")), "labels")
        ones, others = hooks.select(F.col("old").alias("high"), F.col("new").alias("new_high")), hooks.select(F.col("old").alias("low"), F.col("new").alias("new_low"))
        moved = between.join(ones, "high", "left").join(others, "low", "left").select(F.coalesce("new_high", "high").alias("x"), F.coalesce("new_low", "low").alias("y"))
        between = stored(moved.filter("x != y").select(F.greatest("x", "y").alias("high"), F.least("x", "y").alias("low")).distinct(), "edges")
