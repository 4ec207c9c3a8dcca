"""Connected components of a link table, by label exchange and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketlake.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node it can reach.

    Each round takes the smallest label among a node's neighbours and then that label's own label, so that long chains
    halve. Labels shrink until nothing changes. All steps are joins and combining aggregates; a node with many links
    is folded before the exchange, and each round is written down.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        # A label's own label: the node it names has one, since labels are nodes.
        pointed = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = labels.join(pointed, "root").join(seen, F.col("node") == F.col("a"))
        after = stored(after.select("node", F.least("next", "near").alias("root"), (F.least("next", "near") < F.col("root")).alias("moved")))
        labels = after.select("node", "root")
        if after.where("moved").isEmpty():
            return labels
