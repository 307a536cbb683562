"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

P(grade <= k) = logistic(threshold_k - w.x): all thresholds share the weights. Features are letter words and their
beginnings of 4 to 7 bytes (ASCII lower-cased), as log(1 + count), counts above MOST_COUNT as MOST_COUNT, of those that
the labelled sample links to a grade.

The model is fitted, in one task, on a bounded sample: at most SAMPLE documents of each label, drawn whole by a hash of
doc_id until they hold SAMPLE_CHARS characters, and weighted by how many labelled documents each stands for. Scoring
reads every whole text.

Grades. Labels with three or more values are the grades. Labels that say only yes or no have no second threshold to
learn from, so the positive documents are graded 1 or 2 by a weak label: whether the number of telling words in the
text is above their median, with telling words found in the other half of the sample. So no document helps to choose the
words that it is graded by; but the second grade stays derived from texts, as no table tells it.

Edge cases: a null text has no feature and gets the severity of a text without any; null labels are not used; with no
label, or only one label value, every severity is 0 and nothing is rejected; a doc_id labelled twice counts its
highest label; repeated rows get equal results; a very long text is read whole, by itself; columns of docs are kept,
except that severity, expected_severity and toxic replace columns of these names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.llm.blocks import NOT_LETTER, SMALL_SLICE_BYTES, slices, words
from braidwork.llm.sampling import least_hashes
from braidwork.session import small_batches

#: Most documents of a label value, and the characters from which on no more are drawn.
SAMPLE, SAMPLE_CHARS = 4000, 40_000_000
#: Occurrences of a feature in one text beyond which more say no more.
MOST_COUNT = 3
#: Bytes of word beginnings.
BEGINNINGS = (4, 5, 6, 7)
#: Least likelihood ratio statistic of a feature, and how many features are kept at least and at most.
LEAST_RATIO, FEWEST_FEATURES, MOST_FEATURES = 20.0, 8, 8192
_SLOTS = 1 << 21
#: A document is toxic if the probability of a grade above the lowest reaches this.
REJECT = 0.5


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of every feature occurrence."""
    w = words(column, NOT_LETTER)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    spans, row, size = w.spans(lower=True), w.row(), w.end - w.start
    rows, hashes = [row], [spans.hashes(w.start, w.end)]
    for n in BEGINNINGS:
        at = np.flatnonzero(size > n)
        rows.append(row[at])
        hashes.append(spans.hashes(w.start[at], w.start[at] + n) + np.uint64(n))
    return np.concatenate(rows), np.concatenate(hashes)


def amounts(counts: np.ndarray) -> np.ndarray:
    return np.log1p(np.minimum(counts, MOST_COUNT))


@dataclass
class OrdinalModel:
    """Sorted feature hashes with their weights, and the ordered thresholds."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self):
        self.mask = np.zeros(1 << 20, bool)
        self.mask[self.hashes & np.uint64((1 << 20) - 1)] = True

    def sums(self, column: pa.Array) -> np.ndarray:
        """w.x of each row."""
        rows, cols, counts = known_counts(column, self.hashes, self.mask)
        return np.bincount(rows, amounts(counts) * self.weights[cols], minlength=len(column))

    def expected(self, sums: np.ndarray) -> np.ndarray:
        """Expected severity: the sum over the thresholds of P(grade > threshold)."""
        return (1 / (1 + np.exp(np.clip(self.thresholds[None, :] - sums[:, None], -500, 500)))).sum(axis=1)

    def positive(self, sums: np.ndarray) -> np.ndarray:
        """P(grade > 0), from the first threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[0] - sums, -500, 500)))


def known_counts(column: pa.Array, hashes: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of the given sorted hashes; mask tells which low bits occur among them."""
    rows, found = features(column)
    near = np.flatnonzero(mask[found & np.uint64(len(mask) - 1)])
    rows, found = rows[near], found[near]
    at = np.minimum(np.searchsorted(hashes, found), max(len(hashes) - 1, 0))
    hit = hashes[at] == found if len(hashes) else np.zeros(len(found), bool)
    cells, counts = np.unique(rows[hit] * len(hashes) + at[hit], return_counts=True)
    return cells // max(len(hashes), 1), cells % max(len(hashes), 1), counts


def likelihood_ratio(with_high: np.ndarray, with_low: np.ndarray, high: float, low: float) -> np.ndarray:
    """Signed G statistic of a feature's documents among those of high and low labels."""
    n, total = with_high + with_low, high + low

    def part(observed, expected):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    g = 2 * sum(part(o, e) for o, e in ((with_high, n * high / total), (with_low, n * low / total), (high - with_high, (total - n) * high / total), (low - with_low, (total - n) * low / total)))
    return np.where(with_high * total >= n * high, g, -g)


def fit_thresholds(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n_features: int, grades: np.ndarray, weight: np.ndarray, penalty: float = 3e-5, steps: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model by full-batch Adam on the penalised mean log loss."""
    top = int(grades.max())
    share = weight / weight.sum()
    below = np.array([share[grades <= k].sum() for k in range(top)])
    theta = np.log(below / (1 - below))
    # thresholds stay ordered: the first, then logarithms of the steps between them
    p = np.concatenate([np.zeros(n_features), theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    upper, lower = np.minimum(grades, top - 1), np.maximum(grades - 1, 0)

    def logistic(x):
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))

    for t in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        theta = p[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(rows, values * w[cols], minlength=len(grades))
        a = np.where(grades < top, logistic(theta[upper] - s), 1.0)
        b = np.where(grades > 0, logistic(theta[lower] - s), 0.0)
        like = np.maximum(a - b, 1e-12)
        da, db = np.where(grades < top, a * (1 - a), 0.0), np.where(grades > 0, b * (1 - b), 0.0)
        ds = share * (da - db) / like
        dtheta = np.bincount(upper, -share * da / like, minlength=top) + np.bincount(lower, share * db / like, minlength=top)
        tail = np.cumsum(dtheta[::-1])[::-1]
        g = np.concatenate([np.bincount(cols, values * ds[rows], minlength=n_features) + penalty * w / n_features**0.5, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return p[:n_features], p[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 1 :]))])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, text, grade, total): at most sample rows of each label value, and no more once they hold so many
    characters, with how many labelled documents the value has."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("grade"))
    totals = known.groupBy("grade").agg(F.count(F.lit(1)).alias("total"))
    sized = docs.where(F.col("text").isNotNull()).select("doc_id", F.length("text").alias("chars")).join(known, "doc_id").groupBy("doc_id", "grade").agg(F.max("chars").alias("chars"))
    # at most sample small rows of each label value: a bound that holds at every size
    chosen = least_hashes(sized, "grade", "doc_id", sample, "chars", chars).select("doc_id", "grade").join(F.broadcast(totals), "grade")
    met = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id", "grade", "total").agg(F.min("text").alias("text"))


def _fit_sample(table: pa.Table) -> pa.Table:
    table = table.sort_by("doc_id")
    totals = dict(zip(table.column("grade").to_pylist(), table.column("total").to_pylist(), strict=True))
    model = fit(table.select(["text", "grade"]), totals)
    parts = [] if model is None else [[model.hashes.tobytes()], [model.weights.tobytes()], [model.thresholds.tobytes()]]
    return pa.Table.from_arrays([pa.array(p, pa.binary()) for p in parts or [[], [], []]], ["hashes", "weights", "thresholds"])


def fitted(sample: DataFrame) -> OrdinalModel | None:
    """The model of a bounded sample, fitted in one task; what comes back is a few numbers a feature."""
    rows = sample.withColumn("one_task", F.lit(0)).groupBy("one_task").applyInArrow(_fit_sample, "hashes binary, weights binary, thresholds binary").collect()
    if not rows:
        return None
    return OrdinalModel(np.frombuffer(rows[0]["hashes"], np.uint64), np.frombuffer(rows[0]["weights"]), np.frombuffer(rows[0]["thresholds"]))


def weak_grades(parts: list, slot_counts: np.ndarray, positive: np.ndarray, half: np.ndarray) -> np.ndarray:
    """1 for the positive documents with more telling feature occurrences than their median, judged by the counts of the
    other half of the sample (slot_counts: half, side, slot), else 0."""
    telling = np.zeros((2, _SLOTS), bool)
    for h in (0, 1):
        counts, mine = slot_counts[1 - h].astype(float), half != h
        some = np.flatnonzero(counts.sum(axis=0) >= 2)
        telling[h, some] = likelihood_ratio(counts[1, some], counts[0, some], max(float(positive[mine].sum()), 1.0), max(float((~positive)[mine].sum()), 1.0)) >= LEAST_RATIO
    hits = np.zeros(len(positive))
    for first, texts in parts:
        rows, hashes = features(texts)
        hit = telling[half[first + rows], hashes & np.uint64(_SLOTS - 1)]
        hits[first : first + len(texts)] = np.bincount(rows, hit, minlength=len(texts))
    return (positive & (hits > np.median(hits[positive]))).astype(int)


def fit(sample: pa.Table, totals: dict[int, int]) -> OrdinalModel | None:
    """A model of ordered severities, or None if the sample has one label value only."""
    values = np.unique(sample.column("grade").to_numpy()) if sample.num_rows else np.zeros(0)
    if len(values) < 2:
        return None
    grades = np.searchsorted(values, sample.column("grade").to_numpy())
    parts, at = [], 0
    for batch in slices(sample.select(["text"]).combine_chunks().to_batches(), limit=1 << 20):
        parts.append((at, batch.column("text")))
        at += batch.num_rows
    positive = grades > 0
    half = np.arange(len(grades)) % 2
    slot_counts = np.zeros((2, 2, _SLOTS), np.int32)
    for first, texts in parts:
        rows, hashes = features(texts)
        cells = np.unique(rows.astype(np.uint64) * np.uint64(_SLOTS) + (hashes & np.uint64(_SLOTS - 1)))
        row, slots = first + (cells // np.uint64(_SLOTS)).astype(np.int64), (cells & np.uint64(_SLOTS - 1)).astype(np.int64)
        for h in (0, 1):
            for side in (0, 1):
                slot_counts[h, side] += np.bincount(slots[(half[row] == h) & (positive[row] == side)], minlength=_SLOTS).astype(np.int32)
    if len(values) == 2:
        grades = grades + weak_grades(parts, slot_counts, positive, half)
        _, grades = np.unique(grades, return_inverse=True)
    slot_counts = slot_counts.sum(axis=0)
    some = np.flatnonzero(slot_counts.sum(axis=0) >= 2)
    ratio = likelihood_ratio(slot_counts[1][some].astype(float), slot_counts[0][some].astype(float), float(positive.sum()), float((~positive).sum()))
    keep = some[np.argsort(-np.abs(ratio), kind="stable")[: max(FEWEST_FEATURES, int((np.abs(ratio) >= LEAST_RATIO).sum()))]]
    wanted = np.zeros(_SLOTS, bool)
    wanted[keep] = True
    seen_rows, seen_hashes, seen_counts = [], [], []
    for first, texts in parts:
        rows, hashes = features(texts)
        near = wanted[hashes & np.uint64(_SLOTS - 1)]
        pairs = np.rec.fromarrays([rows[near] + first, hashes[near]])
        pairs, counts = np.unique(pairs, return_counts=True)
        seen_rows.append(pairs["f0"])
        seen_hashes.append(pairs["f1"])
        seen_counts.append(counts)
    rows, hashes, counts = np.concatenate(seen_rows), np.concatenate(seen_hashes), np.concatenate(seen_counts)
    names, cols = np.unique(hashes, return_inverse=True)
    high = np.bincount(cols, positive[rows], minlength=len(names))
    ratio = likelihood_ratio(high, np.bincount(cols, minlength=len(names)) - high, float(positive.sum()), float((~positive).sum()))
    best = np.sort(np.argsort(-np.abs(ratio), kind="stable")[: min(MOST_FEATURES, max(FEWEST_FEATURES, int((np.abs(ratio) >= LEAST_RATIO).sum())))])
    place = np.full(len(names), -1)
    place[best] = np.arange(len(best))
    kept = place[cols] >= 0
    rows, cols, counts, names = rows[kept], place[cols[kept]], counts[kept], names[best]
    label_of = sample.column("grade").to_numpy()
    weight = np.array([totals[int(v)] / (label_of == v).sum() for v in values])[np.searchsorted(values, label_of)]
    w, theta = fit_thresholds(rows, cols, amounts(counts), len(names), grades, weight)
    return OrdinalModel(names, w, theta)


def score_severity(docs: DataFrame, labels: DataFrame, label: str = "toxic", reject: float = REJECT) -> DataFrame:
    """docs: (doc_id, text, ...); labels: (doc_id, label). docs with severity (the likeliest of the grades by expected
    value), expected_severity and toxic (a probability of at least reject that the grade is above the lowest)."""
    small_batches(docs.sparkSession)
    model = fitted(labelled_sample(docs, labels, label))
    if model is None:
        return docs.withColumns({"severity": F.lit(0), "expected_severity": F.lit(0.0), "toxic": F.lit(False)})
    sent = docs.sparkSession.sparkContext.broadcast((model.hashes, model.weights, model.thresholds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(*sent.value)
        for batch in slices(batches, limit=SMALL_SLICE_BYTES):
            sums = own.sums(batch.column("text"))
            expected = own.expected(sums)
            extra = [pa.array(np.rint(expected).astype(np.int32)), pa.array(expected), pa.array(own.positive(sums) >= reject)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "severity", "expected_severity", "toxic"])

    kept = docs.drop("severity", "expected_severity", "toxic")
    added = [T.StructField("severity", T.IntegerType()), T.StructField("expected_severity", T.DoubleType()), T.StructField("toxic", T.BooleanType())]
    schema = T.StructType([*kept.schema.fields, *added])
    return kept.mapInArrow(score, schema)
