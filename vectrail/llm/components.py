"""Connected components by minimum labels with pointer jumping, over tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.session import materialize


def components(edges: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(id, label) of every id in an edge; label is the smallest id of its component. Each round takes the smallest label of
    the neighbours (an aggregate, so hubs combine before the shuffle) and then the label's label, which halves the distance
    left; it ends when no label falls, after about the logarithm of the longest path. Ids of any orderable type; null ends are ignored, loops and repeated edges are harmless. Links are never collected."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = materialize(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("label")), "cc-labels")
    while True:
        near = both.join(labels, both.v == labels.id).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.u).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = materialize(step.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "cc-labels")
        moved = new.where("label < old").limit(1).count()
        labels = new.select("id", "label")
        if not moved:
            return labels
