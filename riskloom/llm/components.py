"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import cut_lineage


def smallest_reachable(links: DataFrame, left: str = "x", right: str = "y") -> DataFrame:
    """``node`` and ``label``, the smallest node reachable, for every node that has a link.

    Each round takes the smallest label among a node's neighbours, then the label of that label, so that chains halve.
    Labels only fall; the rounds end when none does. Minima are added up before the shuffle, so a node with very many
    links is no burden. An empty table gives no rows.
    """
    ends = links.select(F.col(left).alias("u"), F.col(right).alias("v"))
    both = cut_lineage(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("_v")).select(F.col("u").alias("node"), F.least("u", "_v").alias("label")))
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("low"))
        lower = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = cut_lineage(lower.join(jump, F.col("label") == F.col("_n"), "left").select("node", "was", F.least("label", "_l").alias("label")))
        if new.filter("label < was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
