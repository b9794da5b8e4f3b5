"""Connected components by minimum labels and pointer jumping, cut after every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """v, label: each vertex of an edge with the smallest vertex that it reaches. No edges give no rows.

    Labels go to neighbours (a grouped minimum, which is summed up before the
    shuffle, so a hub costs no more than its edges) and then to their own
    label's label, so chains halve in each round.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    both = common.cut(e.union(e.select("b", "a")))
    labels = common.cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), F.col("label")), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "v").select("v", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("jump"))
        new = common.cut(lower.join(jump, "label").select("v", F.least("label", "jump").alias("label"), "was"))
        if not new.filter("label <> was").limit(1).count():
            return new.select("v", "label")
        labels = new.select("v", "label")
