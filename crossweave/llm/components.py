"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node it reaches), of every node of links a, b.

    Every round takes over the smallest label among the neighbours and then the label of that label, so chains shorten
    by half. Labels are written to the shared folder after each round.
    """
    stage = scratch.stage
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.select("node", "component").join(near, "node").select("node", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        far = labels.select(F.col("node").alias("to"), F.col("component").alias("far"))
        moved = stage(step.join(far, "to", "left").select("node", F.coalesce(F.least("to", "far"), "to").alias("component"), "was"), "labels")
        scratch.drop(labels)
        labels = moved
        if moved.filter("component <> was").isEmpty():
            scratch.drop(both)
            return labels.select("node", "component")
