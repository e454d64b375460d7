"""Connected components of a link table, by smallest labels with pointer jumping; nothing is held on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from concordat.llm.common import discard, written


def connected(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) to (node, component): the smallest node that is reachable. Nodes without links are absent."""
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    before = labels
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", "component", F.least("component", "near").alias("lower"))
        parent = labels.select(F.col("node").alias("p"), F.col("component").alias("of_p"))
        jumped = lower.join(parent, lower.lower == parent.p, "left").select("node", "component", F.least("lower", F.coalesce("of_p", "lower")).alias("next"))
        moved = written(jumped, "labels")
        discard(before)
        before, labels = moved, moved.select("node", F.col("next").alias("component"))
        if moved.where("next <> component").isEmpty():
            discard(both)
            return labels
