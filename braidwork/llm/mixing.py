"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target in words. Documents are counted by exact word count, whole passes over the source are
taken while they fit, and the remaining budget is fitted on the counts: a proportional share of each length first,
then a bounded-knapsack dynamic programme over what is left. Which documents of a length are taken is drawn by a
seeded hash of doc_id and text, so reruns agree.

Edge cases: a null text has size 0 and is never taken; a null source is a source of its own, ordered last; repeated
rows are separate documents; a null doc_id is an id like others; documents of one source, length and hash go by doc_id
and then by what keep carries; a very long text counts as one length like others; an empty table gives an empty
result; further columns may have any name and are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.blocks import WORD
from braidwork.session import stored

#: Words that the exact programme fits, or twice the longest text; larger remainders are first reduced by whole documents.
EXACT_WORDS = 1 << 16
BUCKETS = 256


def _fill(sizes: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """How many of each size to add, at most left each, for the greatest sum of at most room: a bounded knapsack that
    keeps, for every sum, the item that first reached it."""
    more, left = np.zeros(len(sizes), np.int64), np.minimum(left, room // sizes)
    if not left.any():
        return more
    unit = int(np.gcd.reduce(sizes[left > 0]))
    room //= unit
    by = np.full(room + 1, -1, np.int32)
    by[0], items = 0, [(0, 0, 0)]
    for i in np.argsort(-sizes):
        n, power = int(left[i]), 1
        while n > 0 and by[room] < 0:
            m = min(power, n)
            words = m * int(sizes[i]) // unit
            by[np.flatnonzero((by[:-words] >= 0) & (by[words:] < 0)) + words] = len(items)
            items.append((int(i), m, words))
            n, power = n - m, power * 2
    at = int(np.flatnonzero(by >= 0)[-1])
    while at:
        i, m, words = items[by[at]]
        more[i] += m
        at -= words
    return more


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, exact: int = EXACT_WORDS) -> np.ndarray:
    """How many documents of each size to take, at most counts each, so that the sizes sum to budget or just under it.

    sizes are distinct and positive. The proportional share leaves less than one document of each size; the largest
    sizes are then added while more than limit words are missing, limit being exact or twice the largest size, so that
    all that is still missing fits into the knapsack (4 bytes a word). Where the budget is not met to the word, one, two,
    four, ... documents of each size are given back and fitted anew, as long as at most 2 * limit words are then missing.
    """
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(sizes), np.int64)
    if budget >= total:
        return counts
    share = np.array([int(c) * budget // total for c in counts], np.int64)
    limit = max(exact, 2 * int(sizes.max()))
    best, back, short = share, 0, budget + 1
    while short:
        take = np.maximum(share - back, 0)
        missing = budget - int((take * sizes).sum())
        if back and missing > 2 * limit:
            break
        for i in np.argsort(-sizes):
            if missing <= limit or back:
                break
            more = max(min(int(counts[i] - take[i]), (missing - limit // 2) // int(sizes[i])), 0)
            take[i] += more
            missing -= more * int(sizes[i])
        take = take + _fill(sizes, counts - take, missing)
        if (left := budget - int((take * sizes).sum())) < short:
            best, short = take, left
        if back >= int(share.max()):
            break
        back = max(1, back * 2)
    return best


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """sources: (source, source_size). Adds target: weighted shares of share * all sizes, none above cap * its size.

    The excess of the capped sources goes to the others by weight until none is above, which is to fill all sources
    to one level: target = least(cap * size, weight * level). Ordered by cap / weight, the level follows from
    running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn("most", F.col("source_size") * float(cap))
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    level = (F.sum("source_size").over(all_rows) * float(share) - F.coalesce(F.sum("most").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    levels = weighed.withColumn("own_level", level)
    free = F.col("most") > F.col("weight") * F.col("own_level")
    levels = levels.withColumn("level", F.max(F.when(free, F.col("own_level"))).over(all_rows))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("level")))
    return levels.select("source", "source_size", target.alias("target"))


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts by length of one source: at most one row per distinct length."""
    rows = rows.sort_values("size")
    take = fit_budget(rows["size"].to_numpy(), rows["n"].to_numpy(), int(rows["budget"].iloc[0]))
    return pd.DataFrame({"no_source": rows["no_source"], "name": rows["name"], "size": rows["size"], "extra": take})


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, keep: str | None = None, tie: Column | None = None) -> DataFrame:
    """docs: (doc_id, text, source). Returns doc_id, size, source_size, target, taken, copies, source of each row.

    With keep, a column of docs that is carried along, its value as kept; tie, an expression on docs, tells rows of equal
    doc_id and text apart then.

    taken is size times copies; copies counts the whole passes over the source plus one if the document was drawn.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    # a null source is told apart by a column of its own, so that joins and windows share one shuffle
    sized = docs.select("doc_id", "source", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name"), size.alias("size"), draw.alias("draw"), F.pmod(draw, F.lit(BUCKETS)).cast("int").alias("bucket"), *([F.col(keep).alias("kept"), (F.lit(0) if tie is None else tie).alias("tie")] if keep else []))
    # what is carried may be whole texts: these are counted again instead of being written once more
    sized = sized if keep else stored(sized, "sizes")
    of = ["no_source", "name"]
    counts = stored(sized.groupBy(*of, "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "counts")

    sources = counts.groupBy(*of).agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).withColumn("source", F.when(~F.col("no_source"), F.col("name")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.round(F.col("target"), 6) / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = stored(
        source_targets(sources.select("source", "source_size"), weights, share, cap)
        .withColumn("passes", passes)
        .withColumn("budget", F.round(F.col("target")).cast("long") - F.col("passes") * F.col("source_size"))
        .select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target", "passes", "budget"),
        "targets",
    )
    lengths = counts.where("size > 0").groupBy(*of, "size").agg(F.sum("n").alias("n"))
    asked = lengths.join(targets.select(*of, "budget"), of)
    extra = asked.groupBy(*of).applyInPandas(_fit_source, "no_source boolean, name string, size long, extra long").where("extra > 0")

    one = counts.join(extra, [*of, "size"])
    # at most BUCKETS rows of a source and length
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*of, "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.least(F.col("extra") - before, F.col("n")), F.lit(0))
    rooms = stored(one.select(*of, "size", "bucket", room.alias("room")).where("room > 0"), "rooms")

    rank = F.row_number().over(Window.partitionBy(*of, "size", "bucket").orderBy("draw", F.col("doc_id").asc_nulls_last(), *(["tie"] if keep else [])))
    drawn = sized.join(rooms, [*of, "size", "bucket"], "left").withColumn("extra", (rank <= F.coalesce("room", F.lit(0))).cast("long"))
    copies = F.when(F.col("size") > 0, F.col("passes") + F.col("extra")).otherwise(F.lit(0))
    both = drawn.join(targets.drop("budget"), of)
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.cast("long").alias("copies"), "source", *(["kept"] if keep else []))
