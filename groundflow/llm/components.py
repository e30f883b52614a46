"""Connected components of a graph given as pairs, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep


def components(pairs: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable. pairs: a, b (long).

    Every round each node takes the smallest label among its neighbours, then its label's label, so that the
    number of rounds grows with the logarithm of a component's width. Rounds are written to the shared folder; the tables
    of the one before go."""
    edges = keep(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = keep(edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        lower = keep(lower, "labels")
        above = lower.select(F.col("node").alias("top"), F.col("component").alias("above"))
        jumped = lower.join(above, lower["component"] == above["top"], "left").select("node", "old", F.least("component", "above").alias("component"))
        jumped = keep(jumped, "labels")
        drop(labels, lower)
        labels = jumped.select("node", "component")
        if jumped.where("old <> component").isEmpty():
            return labels
