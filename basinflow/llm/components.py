"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.sources.shared import discard, materialise


def connected_components(links: DataFrame) -> DataFrame:
    """Smallest reachable node for every node that occurs in ``links(a, b)``.

    Each round takes the smallest label among a node and its neighbours, then follows labels once
    (pointer jumping), so long chains shrink geometrically.  Every round is written to the shared
    folder; nothing but one changed-rows count reaches the driver.  Self-links and repeated links
    are harmless, an empty table gives an empty result, links with a null end are ignored.
    """
    both = links.where("a is not null and b is not null").select(F.col("a").alias("node"), F.col("b").alias("other"))
    edges = materialise(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).where("node <> other").distinct(), "links")
    labels = materialise(edges.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        moved = step.join(jump, "new", "left").select("node", F.col("label").alias("old"), F.least("new", F.coalesce("far", "new")).alias("label"))
        moved = materialise(moved, "labels")
        changed = moved.where("old <> label").limit(1).count()
        discard(labels)
        labels = moved.select("node", "label")
        if not changed:
            discard(edges)
            return labels
