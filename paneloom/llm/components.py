"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import shared_table


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b); the label is the component's
    smallest node.

    Each round takes the smallest label of all neighbours and then the label of that
    label, so distances halve; rounds are written, which ends their lineage. Nodes without
    edges are not known here; loops and repeated edges do no harm; no edges give no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    both = shared_table(both.distinct(), "edges")
    labels = shared_table(
        both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.first("a")).alias("label")
        ),
        "labels",
    )
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        lowered = labels.join(near, labels.node == near.a).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        following = shared_table(
            lowered.join(jump, "label", "left").select(
                "node", "old", F.least("label", "next").alias("label")
            ),
            "labels",
        )
        moved = following.filter(F.col("old") != F.col("label")).limit(1).count()
        labels = following.select("node", "label")
        if not moved:
            return labels
