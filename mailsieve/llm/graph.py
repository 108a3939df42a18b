"""Connected classes of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.session import written


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node each one is linked with, directly or not.

    links has columns a and b. Each round takes the smallest label among the neighbours,
    then the label of that label, and is written; minima combine before the shuffle, so a
    node with very many links is no hot group.
    """
    both = links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct()
    both = written(both, "links")
    labels = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "component"), "other")
        near = seen.groupBy("node").agg(F.min("component").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = moved.join(jump, "component", "left").select("node", F.least("component", "further").alias("component"), "old")
        moved = written(moved, "labels")
        labels = moved.select("node", "component")
        if moved.filter("component <> old").limit(1).count() == 0:
            return labels
