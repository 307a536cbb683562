"""Substring dedup: passages of at least WINDOW words that an earlier document holds already.

Seed: every window of WINDOW words picks the run of ANCHOR words in it with the least hash (winnowing), so equal
windows pick equal anchors at equal places. Neighbouring windows that pick the same occurrence form a segment.
Join: anchors are counted by hash; those of one document only are dropped.
Extend: an occurrence whose whole segment also stands in an earlier document repeats it at full length. The others,
at the edges of passages, are extended to both sides window by window: a window of the segment is matched against the
windows of the other first occurrences of the same anchor. Each distinct segment is extended once, in the first
document that has it, so copies cost nothing more and no pair of a group is formed.
Keep: matched windows of a document are merged into maximal repeats, and their words removed.

Segments and windows are matched by two sums of 64 bits over the hashes of their words, so at 10**13 different windows
a false match has a chance of about 10**-13, if their words' own hashes of 64 bits differ; anchors only propose.

Every join is by hash against one aggregated row a key. The keys that hold more than a thousandth of all rows, fewer
than a thousand of them, are dealt over many tasks, so a passage that a third of all documents share is no task's alone.

Edge cases: a null text has no words; a text shorter than a window keeps all its words; a null doc_id is neither
earlier nor later than another and keeps its words; repeated rows share a doc_id, so neither removes the other; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.blocks import Spans, Words, buffers, mix, slices, words
from braidwork.session import stored

WINDOW, ANCHOR = 50, 12
_AT_ONCE = 1 << 15
#: A key with more than this share of the rows is joined in so many parts.
HOT_SHARE, PARTS = 1000, 64
_SECOND = np.uint64(0xD1B54A32D192ED03)


def run_hashes(hashes: np.ndarray) -> tuple[Spans, Spans]:
    """Two independent hashes for runs of words."""
    return Spans(hashes), Spans(mix(hashes ^ _SECOND))


def segments(w: Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor hash, two segment hashes) of each segment; windows are numbered by first
    word."""
    hashes = w.hashes()
    starts, _ = w.grams(hashes, window) if len(hashes) >= window else (np.zeros(0, np.int64), None)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    spans, others = run_hashes(hashes)
    grams = np.arange(len(hashes) - anchor + 1)
    grams = spans.hashes(grams, grams + anchor)
    views = np.lib.stride_tricks.sliding_window_view(grams, window - anchor + 1)
    place = np.concatenate([views[starts[i : i + _AT_ONCE]].argmin(axis=1) for i in range(0, len(starts), _AT_ONCE)]) + starts
    row = w.row()[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    a = np.flatnonzero(fresh)
    b = np.append(a[1:], len(starts)) - 1
    both = [s.hashes(starts[a], starts[b] + window).view(np.int64) for s in (spans, others)]
    return row[a], starts[a] - w.first[row[a]], b - a + 1, grams[place[a]].view(np.int64), *both


def _find_segments(window: int, anchor: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, first, n, *hashes = segments(words(batch.column("text")), window, anchor)
            take = pa.array(row, pa.int64())
            columns = [batch.column("doc_id").take(take), batch.column("text_key").take(take), pa.array(first, pa.int32()), pa.array(n, pa.int32()), *(pa.array(h, pa.int64()) for h in hashes)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "first", "n", "anchor", "segment", "segment2"])

    return find


def _extend(window: int):
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of the listed segments, keyed by anchor and content."""
        for batch in slices(batches):
            w = words(batch.column("text"))
            spans, others = run_hashes(w.hashes())
            lists = batch.column("ends")
            fields = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            first, n, anchor = (fields.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            of = np.repeat(np.arange(len(row)), n)
            at = first[of].astype(np.int64) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            start = w.first[row[of]] + at
            key = mix(spans.hashes(start, start + window) ^ mix(anchor[of].view(np.uint64))).view(np.int64)
            key2 = others.hashes(start, start + window).view(np.int64)
            take = pa.array(row[of], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("text_key").take(take), pa.array(at, pa.int32()), pa.array(key, pa.int64()), pa.array(key2, pa.int64())], ["doc_id", "text_key", "first", "window", "window2"])

    return extend


def join_split(rows: DataFrame, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """rows (with doc_id, text_key and first) joined with keyed, a written table of one row a key with its number of
    rows in n. Fewer than HOT_SHARE keys can hold more than that share, which bounds what is broadcast."""
    total = keyed.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_SHARE > total
    hot = F.broadcast(keyed.where(is_hot).select(*keys, F.lit(True).alias("hot")))
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "text_key", "first"), F.lit(PARTS))).otherwise(0).cast("int")
    parts = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))
    dealt = rows.join(hot, keys, "left").withColumn("part", part).drop("hot")
    return dealt.join(keyed.withColumn("part", parts).drop("n"), [*keys, "part"]).drop("part")


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs: (doc_id, text_key, text). (doc_id, text_key, first, n): runs of n windows, from word first on, that each
    also start in a document of smaller doc_id."""
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    found = docs.mapInArrow(_find_segments(window, anchor), "doc_id long, text_key long, first int, n int, anchor long, segment long, segment2 long")
    n = F.count(F.lit(1)).alias("n")
    span = F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), n
    shared = stored(found.groupBy("anchor").agg(*span).where("lo < hi").select("anchor", "n"), "shared")
    seeds = stored(join_split(found, shared, ["anchor"]), "seeds")

    segment = ["anchor", "segment", "segment2"]
    firsts = stored(seeds.groupBy(segment).agg(F.min("doc_id").alias("lo"), n), "firsts")
    several = stored(firsts.groupBy("anchor").agg(n).where("n > 1"), "several")
    placed = join_split(seeds, firsts, segment)
    whole = placed.where("lo < doc_id").select("doc_id", "text_key", "first", "n")

    edges = join_split(placed.where("lo = doc_id"), several, ["anchor"]).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "n", "anchor")).alias("ends"))
    texts = docs.join(edges, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "ends")
    windows = stored(texts.mapInArrow(_extend(window), "doc_id long, text_key long, first int, window long, window2 long"), "windows")
    lowest = stored(windows.groupBy("window", "window2").agg(*span).where("lo < hi").select("window", "window2", "lo", "n"), "lowest")
    single = join_split(windows, lowest, ["window", "window2"]).where("lo < doc_id").select("doc_id", "text_key", "first", F.lit(1).alias("n"))
    return whole.unionByName(single)


def _cut(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = buffers(batch.column("text"))
            body, totals, removed, kept_hash, kept_runs = data.tobytes(), [], [], [], []
            for r, runs in enumerate(batch.column("runs").to_pylist()):
                tokens = body[offsets[r] : offsets[r + 1]].split()
                merged: list[dict[str, int]] = []
                for run in sorted(runs or (), key=lambda x: x["first"]):
                    end = run["first"] + run["n"] - 1 + window
                    if merged and run["first"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], end)
                    else:
                        merged.append({"start": run["first"], "end": end})
                totals.append(len(tokens))
                removed.append(sum(m["end"] - m["start"] for m in merged))
                for m in reversed(merged):
                    del tokens[m["start"] : m["end"]]
                kept_hash.append(hashlib.sha256(b" ".join(tokens)).hexdigest())
                kept_runs.append(merged)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_hash, pa.string()), pa.array(kept_runs, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats"])

    return cut


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs: (doc_id, text). Per row: doc_id, n_words, n_removed, kept_sha256 of the words that stay, and repeats, the
    word ranges [start, end) of its maximal repeats."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    runs = repeated_windows(rows, window, anchor).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    both = rows.join(runs, ["doc_id", "text_key"], "left").select("doc_id", "text", "runs")
    return both.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:int,end:int>>")
