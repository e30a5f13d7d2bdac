"""Connected components of a link table, with every step's links written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of the nodes of links (a, b): the smallest node each reaches.

    Each round, every node takes the smallest label among its own, its neighbours' and that label's own
    label (pointer jumping), until no label changes; raises rather than stop early.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(rounds):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        after = written(labels.join(seen, "node").join(jump, "component", "left").select("node", F.col("component").alias("old"), F.least("component", "near", "far").alias("component")), "labels")
        if after.filter("old <> component").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
