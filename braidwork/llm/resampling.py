"""Importance resampling towards a target distribution, on hashed word runs (after Xie and others 2023).

Features are all runs of 1 to longest consecutive words, joined by one space; a feature's bucket is the CRC-32 of its
bytes modulo the number of buckets, by the position table of braidwork.llm.crc. Documents and target texts give smoothed
bucket frequencies, a bucket's gain is the floored thousandfold log ratio of the two, and a document's weight the sum of
gains over its features. A draw without replacement proportional to exp(weight / 1000) is the top of weight plus Gumbel
noise, which comes from a hash of doc_id.

Two passes read the texts. Each task adds bucket counts up in one array and sends one row a bucket, so what meets on the
driver is bounded by the number of buckets. Ranks come from counts by score, never from one sorted list.

Edge cases: a null text has no words; a document without features has weight 0; a null doc_id draws noise as the empty
text does and comes first among ties; repeated rows are documents of their own; a very long text is read whole, by
itself; without target texts, or without documents, the counts of that side are 0; other columns, whatever their names,
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.blocks import LOWER, slices, words
from braidwork.llm.crc import span_crcs
from braidwork.session import stored

#: Width of the score ranges that scores are counted by first.
RANGE = 1024
#: What stands between words: ASCII but for letters and digits.
BETWEEN = np.ones(256, bool)
BETWEEN[48:58] = BETWEEN[65:91] = BETWEEN[97:123] = BETWEEN[128:] = False


def feature_buckets(column: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of each feature of some texts, and the number of words of each row."""
    w = words(column, BETWEEN)
    if not len(w):
        none = np.zeros(0, np.int64)
        return none, none, w.counts
    size = w.end - w.start
    # all words in lower case, one space after each, so that a run is a span
    start = np.cumsum(size + 1) - size - 1
    joined = np.full(int(start[-1] + size[-1] + 1), 32, np.uint8)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    joined[np.repeat(start, size) + at] = LOWER[w.data[np.repeat(w.start, size) + at]]
    row, last, rows, found = w.row(), np.repeat(w.first[1:], w.counts), [], []
    for n in range(1, longest + 1):
        first = np.arange(len(w))
        first = first[first + n <= last]
        rows.append(row[first])
        found.append(span_crcs(joined, start[first], start[first + n - 1] + size[first + n - 1]).astype(np.int64) % buckets)
    return np.concatenate(rows), np.concatenate(found), w.counts


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all texts are in each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            total += np.bincount(feature_buckets(batch.column("text"), longest, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of each bucket's counts s and t, in doubles."""
    buckets = len(own)
    all_own, all_target = float(own.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * all_own / ((float(s) + 1) * all_target))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_features, n_words, weight) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches):
            row, bucket, n_words = feature_buckets(batch.column("text"), longest, len(own))
            n, size = batch.num_rows, np.bincount(row, minlength=batch.num_rows)
            # rows come in order within each run length, and sums of whole numbers stay exact
            weight = np.zeros(n, np.int64)
            np.add.at(weight, row, own[bucket])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (size, n_words, weight))], ["doc_id", "n_features", "n_words", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_features long, n_words long, weight long")


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """scored: (doc_id, n_features, n_words, weight, score), with rank: of the documents of at least least_words words,
    the percent of highest scores have ranks 1, 2, ..., ties by doc_id; all others null.

    Scores are counted by ranges of RANGE, then by value within a range, so what stands above each score is known from
    small tables; only documents of scores that reach the draw are ordered, those of one score together."""
    counts = stored(scored.where(F.col("n_words") >= least_words).groupBy("score").agg(F.count(F.lit(1)).alias("n")), "scores").withColumn("range", F.floor(F.col("score") / RANGE))
    earlier = (Window.unboundedPreceding, -1)
    ranges = counts.groupBy("range").agg(F.sum("n").alias("n"))
    # one row a range that occurs
    before = ranges.select("range", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("range")).rowsBetween(*earlier)), F.lit(0)).alias("before"), F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).alias("wanted"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(*earlier)), F.lit(0))
    above = counts.withColumn("inside", inside).join(before, "range").select("score", (F.col("before") + F.col("inside")).alias("above"), "wanted").where("above < wanted")
    placed = scored.join(above, "score", "left").withColumn("near", F.col("above").isNotNull() & (F.col("n_words") >= least_words))
    order = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_features", "n_words"))
    near = placed.where("near").withColumn("rank", (F.col("above") + order).cast("long")).withColumn("rank", F.when(F.col("rank") <= F.col("wanted"), F.col("rank")))
    columns = [*scored.columns, "rank"]
    return near.select(columns).unionByName(placed.where("NOT near").withColumn("rank", F.lit(None).cast("long")).select(columns))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """docs: (doc_id, text, ...); target: (text, ...). (doc_id, n_features, n_words, weight, score, rank) of every
    document; rank is null where it isn't drawn."""
    counts = []
    for texts in (docs, target):
        found = np.zeros(buckets, np.int64)
        for r in bucket_counts(texts, longest, buckets).collect():  # at most one row a bucket
            found[r["bucket"]] = r["n"]
        counts.append(found)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weighed(docs, bucket_gains(*counts), longest).withColumn("score", F.col("weight") + noise)
    return drawn(stored(scored, "scored"), percent, least_words)
