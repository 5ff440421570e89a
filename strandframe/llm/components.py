"""Connected components of a graph of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); label is the smallest node that can be reached.

    Each round, a node and the node that it points to take the smallest label among
    the neighbours', and labels are followed once. Chains shorten by a factor each
    round. Every round is written to the shared folder, so the plan doesn't grow.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        far = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("seen")), "b")
        near = far.join(labels.select(F.col("node").alias("a"), F.col("label").alias("own")), "a")
        better = near.where("seen < own")
        said = better.select(F.col("a").alias("node"), "seen").union(better.select(F.col("own").alias("node"), "seen"))
        least = said.groupBy("node").agg(F.min("seen").alias("seen"))
        taken = labels.join(least, "node", "left").select("node", F.least("label", "seen").alias("label"), F.col("label").alias("before"))
        taken = stored(taken, "labels")
        jump = taken.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = stored(taken.join(jump, "label").select("node", F.least("label", "next").alias("label"), "before"), "labels")
        changed = moved.where("label <> before").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels
