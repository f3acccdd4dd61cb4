"""Graph operators over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import cut_table, drop_table

MOST_ROUNDS = 60


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node that has an edge; a component is named by its smallest node.

    Each round every node takes the smallest label among its neighbours and then the label of that label, so
    labels travel in jumps that double; both steps are joins with map-side combined minima, and the labels are
    written to the shared checkpoint folder after each round, where those of the round before are deleted. Rounds end when nothing changed. Null ends and loops
    are left out; repeated edges count once.
    """
    e = edges.select(F.col(f"`{src}`").alias("u"), F.col(f"`{dst}`").alias("v")).where("u is not null and v is not null and u <> v")
    e = cut_table(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_table(e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    for _ in range(MOST_ROUNDS):
        low = e.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("low"))
        step = labels.join(low, labels.node == low.u, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("low", "label")).alias("label"))
        # the smallest label that any node of a label's own group now has
        groups = step.groupBy(F.col("old").alias("g")).agg(F.min("label").alias("best"))
        step = step.join(groups, step.old == groups.g).select("node", "old", F.least("label", "best").alias("label"))
        jump = step.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        step = step.join(jump, step.label == jump.n2, "left").select("node", F.least("label", F.coalesce("l2", "label")).alias("label"), "old")
        old, step = labels, cut_table(step)
        drop_table(old)
        labels = step.select("node", "label")
        if not step.where("label <> old").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")
