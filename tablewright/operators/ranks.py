"""Order of a whole table without one task that sorts it.

Rows are cut by range of the sort key.  What crosses the borders of the ranges (how many rows are before,
how the last value goes on) is a row a range, so a table of any size is ranked by its ranges in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut_points(df: DataFrame, column: str, intervals: int | None = None) -> list:
    """The least value of each of about so many ranges of equal numbers of rows, ascending; a null is the least value there is.

    intervals: by default the session's shuffle partitions.  The list is as long, however many rows there are.
    An empty table has no cut points.
    """
    n = intervals or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = df.select(F.col(column).alias("v")).repartitionByRange(n, "v").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("v")).alias("least"))
    return [r["least"]["v"] for r in sorted(least.collect(), key=lambda r: r["p"])]


def interval_of(value: Column, points: Sequence, literal: Callable[..., Column] = F.lit) -> Column:
    """The number of the interval that a value is in: those of `cut_points`, each up to the next one.

    Compared with every w-th point first and then with the w that follow, where w is the root of their number.
    """
    width = math.isqrt(len(points)) + 1
    rest = list(points[1:])
    if not rest:
        return F.lit(0)
    every = F.array(*map(literal, rest))
    coarse = F.size(F.filter(F.array(*map(literal, rest[::width])), lambda p: p <= value))
    fine = F.size(F.filter(F.slice(every, F.greatest(coarse - 1, F.lit(0)) * width + 1, F.lit(width)), lambda p: p <= value))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + fine).cast("int")


def _struct_literal(row) -> Column:
    return F.struct(*(F.lit(v).alias(n) for n, v in row.asDict().items()))


def global_ranks(df: DataFrame, key: str, unique: str, descending: bool = False, intervals: int | None = None) -> DataFrame:
    """Df with row_number, rank and dense_rank by a key, over the whole table.

    unique: a column that tells rows of one key apart; row numbers of a key follow it, in the key's direction (rows that are equal in both are numbered in any order).
    Nulls are less than all values.  Columns of df named like the results are replaced.

    Rows are shuffled once, to intervals of (key, unique), so a key that a third of all rows have is
    spread as well.  Each interval is ranked by itself; counts, first and last keys of the intervals, a row each, give
    what is added, also where a key goes on over several intervals.
    """
    rows = df.drop("row_number", "rank", "dense_rank")
    both = F.struct(F.col(key).alias("k"), F.col(unique).alias("u"))
    points = cut_points(rows.select(both.alias("b")), "b", intervals)
    placed = rows.withColumn("__i", interval_of(both, points, _struct_literal)).repartitionById(max(1, len(points)), F.col("__i"))
    way = (lambda c: F.desc_nulls_last(c)) if descending else (lambda c: F.asc_nulls_first(c))
    by_key = Window.partitionBy("__i").orderBy(way(key))
    numbered = placed.select(
        "*",
        F.row_number().over(Window.partitionBy("__i").orderBy(way(key), way(unique))).cast("long").alias("row_number"),
        F.rank().over(by_key).cast("long").alias("rank"),
        F.dense_rank().over(by_key).cast("long").alias("dense_rank"),
    )
    ends = numbered.groupBy("__i").agg(F.count("*").alias("n"), F.max("rank").alias("last_rank"), F.max("dense_rank").alias("kinds"), F.min(F.struct("row_number", F.col(key).alias("k"))).alias("a"), F.max(F.struct("row_number", F.col(key).alias("k"))).alias("z"))
    order = Window.orderBy(F.desc("__i") if descending else F.col("__i"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.coalesce(F.col("a.k").eqNullSafe(F.lag("z.k").over(order)) & F.lag("n").over(order).isNotNull(), F.lit(False))
    ends = ends.withColumns({"added": F.coalesce(F.sum("n").over(before), F.lit(0)), "goes_on": goes_on})
    # Where the run of an interval's last key starts; not known to an interval that lies within one run.
    ends = ends.withColumn("run", F.when(~(F.col("goes_on") & (F.col("kinds") == 1)), F.col("added") + F.col("last_rank")))
    ends = ends.withColumns({"from": F.last("run", ignorenulls=True).over(before), "more_kinds": F.coalesce(F.sum(F.col("kinds") - F.col("goes_on").cast("long")).over(before), F.lit(0)) - F.col("goes_on").cast("long")})
    out = numbered.join(F.broadcast(ends.select("__i", "added", "goes_on", "from", "more_kinds")), "__i")
    rank = F.when(F.col("goes_on") & (F.col("dense_rank") == 1), F.col("from")).otherwise(F.col("rank") + F.col("added"))
    return out.select(*rows.columns, (F.col("row_number") + F.col("added")).alias("row_number"), rank.alias("rank"), (F.col("dense_rank") + F.col("more_kinds")).alias("dense_rank"))


def fill_down(df: DataFrame, order: list[str], value: str, name: str, intervals: int | None = None) -> DataFrame:
    """Df with a column `name`: the last value that is not null at or before a row, in an order over the whole table.

    Rows are shuffled once, to intervals of the order; what an interval starts with is the last value of those before it, a row
    an interval.  Rows that are equal in the order are filled in any order, so it should tell those with values apart.
    """
    key = F.struct(*order)
    points = cut_points(df.select(key.alias("b")), "b", intervals)
    placed = df.withColumn("__i", interval_of(key, points, _struct_literal)).repartitionById(max(1, len(points)), F.col("__i"))
    filled = placed.withColumn("__own", F.last(value, ignorenulls=True).over(Window.partitionBy("__i").orderBy(*order)))
    ends = placed.groupBy("__i").agg(F.max_by(value, F.when(F.col(value).isNotNull(), key)).alias("end"))
    before = Window.orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__i", F.last("end", ignorenulls=True).over(before).alias("__before"))
    return filled.join(F.broadcast(ends), "__i").withColumn(name, F.coalesce("__own", "__before")).drop("__i", "__own", "__before")
