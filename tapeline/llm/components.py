"""Connected components of an edge table by minimum labels and pointer jumping, in shuffled joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """node, label: for every node of the edges (a, b) the smallest node that it reaches.

    Each round takes the least label among a node and its neighbours and then that label's own label, so that
    paths of labels halve; labels are written to the shared folder after each round. No edges give no rows."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        better = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        upper = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = better.join(upper, "label").select("node", F.least("label", "above").alias("label"), "was")
        found = written(jumped, "labels")
        labels = found.select("node", "label")
        if found.where("label != was").isEmpty():
            return labels
