"""Audit of how sources of a language differ: divergences between sources, and the terms that mark each source.

A term's smoothed, scaled share in a group is p = 1 + floor(10^9 * (count + 1) / (N + V)), so it depends on the group
only through the count. Terms are therefore never compared one by one: those with equal counts in the two groups that
are compared form a cell, f = floor((p - q)^2 / q) is evaluated once a cell, and a cell counts as often as it has terms.

Terms that mark a source: cells of (count in the source, count in the language); cells of equal f are merged, merged
cells are ranked by the terms before them, and only those that reach the first ranks are expanded into terms, in UTF-8
order. Divergence of two sources: cells of (count in one, count in the other). Cells of terms that both have come from a
join of the counts by term; cells with a zero follow from each source's own counts and those, so absent terms are
never listed.

Texts are read once, and counted in slices of 1 MB. Counts of slices are held up to 24 MB, added up, and leave as one
row for each distinct language, source and term, in batches of 65,536 rows; Spark adds them up.
What a task or the driver holds is bounded by these and by the number of sources of a language; the join by term
gives, for each kept term, the pairs of sources that have it, as the divergence of every pair is asked for.

Edge cases: null text, language and source are the empty string; a group without terms has its rows of divergences and
no term rows; a language without kept terms gives value 0 for all its pairs; a language of one source has no pair
rows; repeated rows are documents of their own; a very long text is read whole, by itself; other columns, whatever their
names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.blocks import LOWER, NOT_LETTER, slices, words
from braidwork.session import small_batches, stored

#: Bytes of text that are counted at once.
COUNTED_BYTES = 1 << 20
#: Bytes of counts that are held before they are added up, and rows that leave a worker at once.
HELD_BYTES, SENT_ROWS = 24 << 20, 1 << 16
KEYS, COUNTS = ["lang", "source", "term"], ["n", "docs"]
SCALE = 1_000_000_000


def _slice_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of some rows, with a row without term for each group."""
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(len(source.dictionary), 1) + source.indices.to_numpy(zero_copy_only=False)
    groups, group = np.unique(group, return_inverse=True)
    w = words(batch.column("text"), NOT_LETTER)
    size = w.end - w.start
    inside = np.zeros(len(w.data), bool)
    if len(w):
        step = np.zeros(len(w.data) + 1, np.int8)
        step[w.start] = 1
        step[w.end] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    offsets = np.zeros(len(w) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    terms = pa.LargeStringArray.from_buffers(len(w), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(LOWER[w.data[inside]]))).dictionary_encode()
    term, row = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), w.row()
    width = max(len(terms.dictionary), 1)
    cells, n = np.unique(group[row] * width + term, return_counts=True)
    pairs = np.unique(row * width + term)
    docs = np.unique(group[pairs // width] * width + pairs % width, return_counts=True)[1]
    own = np.concatenate([cells // width, np.arange(len(groups))])
    extra, sources = np.zeros(len(groups), np.int64), max(len(source.dictionary), 1)
    names = pa.chunked_array([pc.take(terms.dictionary, pa.array(cells % width)).cast(pa.string()), pa.nulls(len(groups), pa.string())]).combine_chunks()
    columns = [pc.take(lang.dictionary, pa.array(groups[own] // sources)), pc.take(source.dictionary, pa.array(groups[own] % sources)), names, pa.array(np.concatenate([n, extra])), pa.array(np.concatenate([docs, extra]))]
    return pa.RecordBatch.from_arrays(columns, [*KEYS, *COUNTS])


def _added_up(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = pa.Table.from_batches(parts).group_by(KEYS, use_threads=False).aggregate([(c, "sum") for c in COUNTS])
    yield from sums.select([*KEYS, *[f"{c}_sum" for c in COUNTS]]).rename_columns([*KEYS, *COUNTS]).to_batches(SENT_ROWS)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the rows of a task, a key in several rows at most where counts exceed HELD_BYTES."""
    parts, held = [], 0
    for batch in slices(batches, limit=COUNTED_BYTES):
        parts.append(_slice_counts(batch))
        held += parts[-1].nbytes
        if held >= HELD_BYTES:
            yield from _added_up(parts)
            parts, held = [], 0
    if parts:
        yield from _added_up(parts)


def term_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, first): how often each source has each term that the language keeps, and how often
    the language has it; first marks one row a term of the language. A row without term for each group."""
    small_batches(docs.sparkSession)
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], "text")
    found = named.mapInArrow(_counts, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # at most one row a source
    seen = found.select("lang", "source", "term", "n", F.sum("docs").over(term).alias("lang_docs"), F.sum("n").over(term).alias("lang_n"), (F.col("source") == F.min("source").over(term)).alias("first"))
    return seen.where(F.col("term").isNull() | (F.col("lang_docs") >= least_docs)).drop("lang_docs")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), in whole numbers."""
    return 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)"), F.greatest(total + kept, F.lit(1)).cast("decimal(19,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), in whole numbers."""
    return F.call_function("div", (p - q) * (p - q), q)


def group_totals(counts: DataFrame) -> DataFrame:
    """(lang, source, no, total, kinds, kept, lang_total) of every group: its number within the language, how many
    occurrences and terms it has, and the language's kept terms and their occurrences."""
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("kinds"))
    langs = counts.groupBy("lang").agg(F.count_if(F.col("first") & F.col("term").isNotNull()).alias("kept"), F.sum(F.when(F.col("term").isNotNull(), F.col("n"))).alias("lang_total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).alias("no")
    return own.join(langs, "lang").select("lang", "source", number, "total", "kinds", "kept", F.coalesce("lang_total", F.lit(0)).alias("lang_total"))


def pair_values(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, q_no, value) of every ordered pair of sources of a language: f summed over all kept terms.

    With f(x, y) of counts x and y, the sum over all terms is that of f(x, 0) over the terms of one source, of f(0, y) over
    those of the other, of f(0, 0) over those of neither, and of f(x, y) - f(x, 0) - f(0, y) over those of both."""
    held = counts.where("term IS NOT NULL").join(totals.select("lang", "source", "no"), ["lang", "source"]).select("lang", "term", "no", "n")
    held = stored(held, "held")
    one, two = held.select("lang", "term", F.col("no").alias("a"), F.col("n").alias("x")), held.select("lang", "term", F.col("no").alias("b"), F.col("n").alias("y"))
    # at most the pairs of sources a term
    both = stored(one.join(two, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "x", "y").agg(F.count(F.lit(1)).alias("m")), "cells")
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("y").alias("x"), F.col("x").alias("y"), "m"))
    p = totals.select("lang", F.col("no").alias("a"), F.col("total").alias("a_total"), F.col("kinds").alias("a_kinds"), "kept")
    q = totals.select("lang", F.col("no").alias("b"), F.col("total").alias("b_total"), F.col("kinds").alias("b_kinds"))
    zero = F.lit(0)

    def f(x: Column, y: Column) -> Column:
        return gap(share(x, F.col("a_total"), F.col("kept")), share(y, F.col("b_total"), F.col("kept")))

    met = both.join(p, ["lang", "a"]).join(q, ["lang", "b"])
    x, y = F.col("x"), F.col("y")
    shared = met.select("lang", "a", "b", (F.col("m") * (f(x, y) - f(x, zero) - f(zero, y))).alias("v"), F.col("m").alias("common"))
    own = held.groupBy("lang", F.col("no").alias("a"), F.col("n").alias("x")).agg(F.count(F.lit(1)).alias("m")).join(p, ["lang", "a"])
    of_one = own.join(q, "lang").where("a <> b").select("lang", "a", "b", (F.col("m") * f(x, zero)).alias("v"), zero.cast("long").alias("common"))
    other = own.select("lang", F.col("a").alias("b"), F.col("x").alias("y"), "m", F.col("a_total").alias("b_total"), F.col("kept"))
    of_two = other.join(p.drop("kept"), "lang").where("a <> b").select("lang", "a", "b", (F.col("m") * f(zero, y)).alias("v"), zero.cast("long").alias("common"))
    sums = shared.unionByName(of_one).unionByName(of_two).groupBy("lang", "a", "b").agg(F.sum("v").alias("v"), F.sum("common").alias("common"))
    every = p.join(q, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")
    rest = F.col("kept") - F.col("a_kinds") - F.col("b_kinds") + F.coalesce("common", zero)
    value = F.when(F.col("kept") == 0, F.lit(0).cast("long")).otherwise(F.coalesce("v", zero) + rest * f(zero, zero))
    named = totals.select("lang", F.col("no").alias("a"), "source"), totals.select("lang", F.col("no").alias("b"), F.col("source").alias("item"))
    return every.join(named[0], ["lang", "a"]).join(named[1], ["lang", "b"]).select("lang", "source", "item", value.alias("value"))


def marking_terms(counts: DataFrame, totals: DataFrame, ranks: int) -> DataFrame:
    """(lang, source, item, value, rank): the kept terms of a source with p above the language's q, by f, up to rank ranks."""
    held = counts.where("term IS NOT NULL")
    cells = held.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("m")).join(totals, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    cells = cells.withColumns({"p": p, "q": q}).where("p > q").select("lang", "source", "n", "lang_n", "m", gap(F.col("p"), F.col("q")).alias("value"))
    cells = stored(cells, "cells")
    group = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    merged = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    # each value has a term at least, so later ones than these can't reach the ranks
    top = merged.withColumn("r", F.row_number().over(group)).where(F.col("r") <= ranks)
    above = F.coalesce(F.sum("m").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = top.withColumn("above", above).where(F.col("above") < ranks).select("lang", "source", "value", "above")
    terms = cells.join(wanted, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value", "above")
    met = held.select("lang", "source", "n", "lang_n", "term").join(terms, ["lang", "source", "n", "lang_n"])
    equal = Window.partitionBy("lang", "source", "value").orderBy("term")
    first = met.withColumn("r", F.row_number().over(equal)).where(F.col("r") <= ranks)
    return first.withColumn("rank", (F.col("above") + F.col("r")).cast("int")).where(F.col("rank") <= ranks).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def audit_sources(docs: DataFrame, least_docs: int = 3, ranks: int = 200) -> DataFrame:
    """docs: (text, lang, source, ...). (lang, source, part, item, value, rank): part pair has every other source of the
    language by divergence, part term the terms that mark the source."""
    counts = stored(term_counts(docs, least_docs), "counts")
    totals = stored(group_totals(counts), "totals")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")  # at most one row a source
    pairs = pair_values(counts, totals).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = marking_terms(counts, totals, ranks).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(terms.select(columns))
