"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; ``root`` is the smallest node it reaches.

    ``edges`` has long columns ``a`` and ``b``.  Each round takes the least label
    among neighbours and then follows labels one step further, so a round more
    than doubles the reach; rounds are stored, and end when no label changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = common.materialise(both, "edges")
    labels = common.materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        moved = labels.join(near, "node").select("node", "root", F.least("root", "least").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        moved = moved.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("root"), (F.least("next", F.coalesce("far", "next")) < F.col("root")).alias("changed"))
        moved = common.materialise(moved, "labels")
        labels = moved.select("node", "root")
        if moved.filter("changed").isEmpty():
            return labels
