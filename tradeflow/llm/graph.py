"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable; only nodes with an edge are listed.

    edges has a and b. Each round gives every node the smallest label among itself and its
    neighbours, then the label of that label, so that rounds follow the logarithm of a chain's
    length. Labels of nodes are minima combined map-side; a hub with many edges is one key of an
    equi-join that Spark splits. A round's table is written to the shared folder."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut(both)
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(most_rounds):
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("l2"))
        near = labels.join(heard, "node").select("node", F.least("label", "l2").alias("label"), F.col("label").alias("old"))
        near = cut(near)
        up = near.select(F.col("node").alias("label"), F.col("label").alias("l3"))
        new = cut(near.join(up, "label", "left").select("node", F.least("label", F.coalesce("l3", "label")).alias("label"), "old"))
        moved = not new.where("label <> old").isEmpty()
        labels = new.select("node", "label")
        if not moved:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
