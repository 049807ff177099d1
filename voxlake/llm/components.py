"""Connected components of an edge table, without a hub in any task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import cut, join_with_hot_keys


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of the edges.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so paths halve.
    Neighbours' minima combine before the shuffle; labels of hubs, and labels that very many nodes have, are looked up
    in every task. Labels only fall, and every round is written to the shared folder, so lost executors cost one
    round. No edges give no rows; null ends are left out.
    """
    both = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u is not null and v is not null")
    both = cut(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
    labels = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root"), F.count("*").alias("degree")).withColumnRenamed("u", "node")
    labels = cut(labels, "labels")
    links, nodes = both.count(), labels.count()
    while True:
        near = join_with_hot_keys(both, labels.select(F.col("node").alias("v"), "root", "degree"), "v", "degree", links).groupBy("u").agg(F.min("root").alias("near"))
        lower = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", "degree", F.col("root").alias("before"), F.least("root", "near").alias("root"))
        lower = cut(lower, "lower")
        members = lower.groupBy("root").agg(F.count("*").alias("members"))
        jump = members.join(lower.select(F.col("node").alias("root"), F.col("root").alias("next")), "root")
        jumped = join_with_hot_keys(lower, jump, "root", "members", nodes)
        jumped = cut(jumped.select("node", "degree", F.col("next").alias("root"), (F.col("next") < F.col("before")).alias("moved")), "labels")
        if not jumped.filter("moved").limit(1).count():
            return jumped.select("node", "root")
        labels = jumped.select("node", "degree", "root")
