"""Connected components over an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidebar.llm.common import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): each node of an edge with the least node it can reach.

    A round gives each node the least label around it and then follows labels once, so
    chains shorten by half; labels are cut to the checkpoint folder after each round.
    Nodes with many edges are combined map-side and their joins are left to adaptive
    execution, which splits them.
    """
    edges = saved(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct())
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = saved(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")))
    while True:
        around = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        near = labels.join(around, labels.node == around.u).select("node", "label", F.least("label", "near").alias("next"))
        far = labels.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        stepped = saved(near.join(far, near.next == far.at).select("node", F.least("next", "jump").alias("next"), "label"))
        changed = stepped.where("next != label").limit(1).count()
        labels = stepped.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
