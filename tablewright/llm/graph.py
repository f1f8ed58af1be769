"""Connected components of links, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.store import release, settle


def components(links: DataFrame) -> DataFrame:
    """For links (a, b), the least id that each id reaches: (v, c), for the ids in links.

    Each round takes the least label among neighbours, then the label of that label, so
    the number of rounds grows with the logarithm of a path's length; labels are cut off
    from their lineage in the shared folder each round.
    """
    both = settle(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = settle(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("c")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("near"))
        least = labels.join(near, "v").select("v", F.least("c", "near").alias("to"), "c")
        jump = labels.select(F.col("v").alias("to"), F.col("c").alias("further"))
        new = settle(least.join(jump, "to", "left").select("v", F.least("to", F.coalesce("further", "to")).alias("c"), F.col("c").alias("was")))
        changed = new.where("c <> was").limit(1).count()
        release(labels)
        labels = new.select("v", "c")
        if not changed:
            release(both)
            return labels
