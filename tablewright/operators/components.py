"""Connected components of links, in rounds of joins; nothing is collected but whether a label changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.plans.stages import settle


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of a link the least node that it reaches.

    Nodes may be of any type that has an order, structs too; links that lack an end are none, one of a node with itself makes it a node of its own.  Repeated and
    reversed links count once.  A round gives each node the least label of its neighbours (summed up before the shuffle,
    so a hub costs a row a task) and then that label's own label; labels are cut from their lineage every round, and the number
    of rounds grows with the logarithm of the longest path.
    """
    one = links.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    both = settle(one.union(one.select("b", "a")).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        new = settle(least.join(jump, "to", "left").select("node", F.least("to", F.coalesce("further", "to")).alias("label"), F.col("label").alias("was")))
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
