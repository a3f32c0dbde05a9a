"""Connected components of a link table, by label propagation over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrine.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(k, label) for every node of `links` (a, b): the smallest node that links lead to.

    A round takes the least label among a node and its neighbours, then the label of that label, so a chain
    shortens by more than half. A hub meets its neighbours through an aggregate and joins on unique keys, and
    each round is a table that survives lost executors.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("k")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("k").alias("b"), "label"), "b").groupBy(F.col("a").alias("k")).agg(F.min("label").alias("near"))
        near = labels.join(around, "k").select("k", F.col("label").alias("old"), F.least("label", "near").alias("near"))
        further = labels.select(F.col("k").alias("near"), F.col("label").alias("far"))
        moved = materialize(near.join(further, "near").select("k", "old", F.least("near", "far").alias("label")), "labels")
        labels = moved.select("k", "label")
        if moved.where("old <> label").isEmpty():
            return labels
