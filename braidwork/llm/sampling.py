"""Bounded samples of labelled rows, drawn by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the hash that rows are counted by before any are ranked: 2 ** RANGE_BITS.
RANGE_BITS = 12


def least_hashes(rows: DataFrame, group: str, key: str, n: int, size: str | None = None, budget: int = 0) -> DataFrame:
    """The n rows of least hash of key in each group (ties by key). With size, a column, no further row is taken once
    the sizes of those before it reach the budget; so a group always has a row, and long rows are as likely as others.

    Rows are counted by group and hash range first, and only those in the ranges that the n least fall into are
    ranked; so no task sees a whole group."""
    hashed = rows.withColumn("_h", F.xxhash64(key)).withColumn("_range", F.shiftright("_h", 64 - RANGE_BITS))
    counts = hashed.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most 2 ** RANGE_BITS rows a group
    wanted = counts.withColumn("_before", before).where(F.col("_before") < n).select(group, "_range")
    near = hashed.join(F.broadcast(wanted), [group, "_range"])
    order = Window.partitionBy(group).orderBy("_h", key)
    ranked = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    if size:
        earlier = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = ranked.withColumn("_size", earlier).where(F.col("_size") < budget).drop("_size")
    return ranked.drop("_h", "_range", "_r")
