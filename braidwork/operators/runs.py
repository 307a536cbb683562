"""Ordered rows: runs, islands, running counts, overlays of intervals and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_runs(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Adds run: how many changes of state the key has had, counted from 1."""
    w = Window.partitionBy(key).orderBy(*order)
    fresh = F.coalesce((~F.lag(state).over(w).eqNullSafe(F.col(state))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    return df.withColumn("run", F.sum(F.when(first, F.lit(1)).otherwise(fresh)).over(w))


def islands(df: DataFrame, key: str, order: list[str], state: str, least: int = 1) -> DataFrame:
    """(key, run, state, n, first, last): runs of at least so many rows, with the order value of both ends."""
    runs = with_runs(df, key, order, state).groupBy(key, "run", state)
    return runs.agg(F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last")).where(F.col("n") >= least)


def element_counts(df: DataFrame, key: str, order: list[str], state: str, blank: str) -> DataFrame:
    """(key, elements): changes to a state that is not blank and differs from the last one that was not."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    solid = F.when(F.col(state) != blank, F.col(state))
    marked = df.withColumn("before", F.last(solid, ignorenulls=True).over(w))
    new = (F.col(state) != blank) & (F.col("before").isNull() | (F.col("before") != F.col(state)))
    return marked.groupBy(key).agg(F.count_if(new).alias("elements"))


def first_value(df: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """(key, kept): the first value that is not null."""
    return df.withColumn("kept_value", value).where("kept_value IS NOT NULL").groupBy(key).agg(F.min_by("kept_value", F.struct(*order)).alias("kept"))


def offsets(sizes: DataFrame, key: str, size: str, by: str, buckets: int = 1024) -> DataFrame:
    """(key, offset): running total of the sizes before a key, over all keys in order of by.

    Keys are cut into ranges by value of by, whose totals are summed first; so no task sorts all keys."""
    span = sizes.agg(F.min(by).alias("lo"), F.max(by).alias("hi"))
    width = F.greatest((F.col("hi") - F.col("lo") + 1) / buckets, F.lit(1.0))
    placed = sizes.crossJoin(span).withColumn("bucket", F.floor((F.col(by) - F.col("lo")) / width))  # one row of bounds
    totals = placed.groupBy("bucket").agg(F.sum(size).alias("total"))
    before = totals.withColumn("base", F.coalesce(F.sum("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("bucket").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum(size).over(w), F.lit(0))
    return placed.join(before.select("bucket", "base"), "bucket").select(key, (F.col("base") + inner).alias("offset"))


def overlay(points: DataFrame, intervals: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """points with the value of the interval [first, last] that covers them, the last one that starts, or null.

    Intervals of a key that do not overlap are met by a running last value, so no range join is needed."""
    marks = intervals.select(key, F.col("first").alias("_at"), F.lit(0).alias("_kind"), F.col("last").alias("_until"), F.col(value).alias("_value"))
    rows = points.withColumn("_at", F.col(at)).withColumn("_kind", F.lit(1))
    both = rows.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_kind") == 0, F.struct("_until", "_value")), ignorenulls=True).over(w)
    got = both.withColumn("_seen", seen).where("_kind = 1")
    return got.withColumn("covering", F.when(F.col("_seen._until") >= F.col(at), F.col("_seen._value"))).select(*points.columns, "covering")


def step_to_next(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """df with step: the value of the key's next row less this one's."""
    return df.withColumn("step", F.lead(value).over(Window.partitionBy(key).orderBy(*order)) - F.col(value))


def gap_openings(df: DataFrame, key: str, order: list[str], gap: Column) -> DataFrame:
    """(key, openings): how many runs of gaps a key has."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("_gap", gap).withColumn("_open", F.col("_gap") & ~F.coalesce(F.lag("_gap").over(w), F.lit(False)))
    return marked.groupBy(key).agg(F.count_if("_open").alias("openings"))


def breaks(alignment: DataFrame) -> DataFrame:
    """(i, j, gaps): how often the aligned residues (i, j, p, q) of a pair do not follow each other in both chains."""
    w = Window.partitionBy("i", "j").orderBy("p")
    off = (F.col("p") != F.lag("p").over(w) + 1) | (F.col("q") != F.lag("q").over(w) + 1)
    return alignment.withColumn("_off", F.coalesce(off, F.lit(False))).groupBy("i", "j").agg(F.count_if("_off").alias("gaps"))


def column_counts(df: DataFrame, key: str, order: list[str], state: str, states: list[str]) -> DataFrame:
    """(col, n, gaps and one count a state): rows of a key are its columns in order; keys of fewer rows have gaps in the
    later columns."""
    placed = df.withColumn("col", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    total = df.select(key).distinct().agg(F.count(F.lit(1)).alias("keys"))
    counted = placed.groupBy("col").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(state) == s).alias(f"n_{s}") for s in states])
    return counted.crossJoin(F.broadcast(total)).select("col", "n", (F.col("keys") - F.col("n")).alias("gaps"), *[f"n_{s}" for s in states])  # one row


def renumbered(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column, new_col): the columns that occur for a key, numbered from 1 without those that never do."""
    cells = df.select(key, column).distinct()
    return cells.withColumn("new_col", F.dense_rank().over(Window.partitionBy(key).orderBy(column)))
