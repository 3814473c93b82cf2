"""Connected components of a link table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``links`` (a, b): label is the smallest vertex of its component.

    Each round takes the smallest label among neighbours, then the label's own label
    (pointer jumping), so the rounds grow with the logarithm of the longest path.
    Labels are unique per vertex, so a vertex with very many links only skews the side
    that AQE can split; minima are combined before each shuffle.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("v")).agg(F.min("near").alias("near"))
        lower = labels.join(near, "v").select("v", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        step = materialize(lower.join(jump, "label").select("v", "before", F.least("label", "far").alias("label")), "labels")
        changed = not step.where(F.col("label") != F.col("before")).isEmpty()
        discard(labels)
        labels = step.select("v", "label")
        if not changed:
            discard(both)
            return labels
