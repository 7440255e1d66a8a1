"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in the links (a, b); the component is its smallest node.

    Each round takes the smallest label around a node and then the label of that label, so
    chains halve. Only minima are shuffled, pre-aggregated, so a hub costs no more than its
    links. Rounds go on until none changes a label, however long the paths are; lineage is cut
    by a reliable checkpoint each round.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(around, labels["node"] == around["a"]).select("node", "label", F.least("label", "near").alias("next"))
        of = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        stepped = lower.join(of, "next").select("node", F.least("next", "jump").alias("label"), (F.least("next", "jump") < F.col("label")).alias("moved"))
        stepped = cut_lineage(stepped)
        if not stepped.where("moved").limit(1).count():
            return stepped.select("node", F.col("label").alias("component"))
        labels = stepped.select("node", "label")
