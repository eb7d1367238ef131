"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import materialize


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of an edge table; the component is its smallest node.

    Each round a node takes the smallest label among itself and its neighbours
    and then the label of that label, so a chain of length n settles in about
    log n rounds.  Every round is written to the shared folder, which cuts the
    lineage; nothing but one changed-row count per round reaches the driver.
    Self-edges give single nodes; null ends are ignored; an empty table gives
    an empty result.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = materialize(one.union(one.select("v", "u")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("component").alias("low"))
        step = labels.join(near, labels.node == near.u, "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("low", "component")).alias("mid"))
        parent = labels.select(F.col("node").alias("p"), F.col("component").alias("up"))
        after = materialize(
            step.join(parent, step.mid == parent.p, "left").select("node", "old", F.least("mid", F.coalesce("up", "mid")).alias("component")), "labels"
        )
        changed = after.where("old <> component").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
