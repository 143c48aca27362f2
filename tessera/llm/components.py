"""Connected components with DataFrame joins: least labels, hooked on and cut short in every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long) -> node, label: label is the least node of the component. Nodes without edges are left out.

    Each round takes the least label among the neighbours, hands it to the node and to the node that its label
    names, then replaces labels by the labels' labels. Distances halve, so rounds grow as the logarithm of the
    longest path. Only per-node minima are kept, with a combine before each shuffle.
    """
    both = edges.select("a", "b").where(F.col("a") != F.col("b"))
    both = durable(both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        seen = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("m"))
        offers = seen.select("node", "m").unionAll(seen.select(F.col("label").alias("node"), "m"))
        hooked = offers.groupBy("node").agg(F.min("m").alias("m"))
        up = hooked.select(F.col("node").alias("m"), F.col("m").alias("m2"))
        new = hooked.join(up, "m", "left").select("node", F.least("m", F.coalesce("m2", "m")).alias("label"))
        new = durable(new, "labels")
        old = labels.withColumnRenamed("label", "old")
        changed = new.join(old, "node").where(F.col("label") != F.col("old")).limit(1).count()
        labels = new
        if not changed:
            return labels
