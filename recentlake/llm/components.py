"""Connected components of a graph given as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recentlake.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns a, b): the
    smallest node that it reaches.

    Labels spread to neighbours and then jump to their label's label, so the
    rounds grow with the logarithm of the longest path.  Each round is written
    to the shared folder; only the number of changed labels reaches the driver.
    """
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                 .where("a <> b").distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("__near"))
        spread = labels.join(near, "node").select("node", F.col("component").alias("__old"), F.least("component", "__near").alias("__new"))
        jump = labels.select(F.col("node").alias("__new"), F.col("component").alias("__next"))
        moved = saved(spread.join(jump, "__new", "left").select(
            "node", F.least("__new", F.coalesce("__next", "__new")).alias("component"),
            (F.least("__new", F.coalesce("__next", "__new")) != F.col("__old")).alias("moved")), "labels")
        labels = moved.select("node", "component")
        if not moved.where("moved").limit(1).count():
            return labels
