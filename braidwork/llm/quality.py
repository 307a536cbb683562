"""Document quality by attention-based multiple-instance learning (Ilse, Tomczak and Welling 2018).

A document is a bag of passages of PASSAGE words. Every passage is encoded: its shape (shares of byte classes, of
capitals, of words without letters, of words that repeat in it, that stand beside their like or are new in the document,
lengths, its place) goes through a learned tanh layer, h. A gated attention, softmax over the passages of
w.(tanh(V h) * sigmoid(U h)), weighs them, and the weighted representation gives the probability of label 1. All weights
are learned together from document labels only.

The model is fitted, in one task, on a bounded sample: at most SAMPLE labelled documents of each label, drawn whole by a
hash of doc_id until they hold SAMPLE_CHARS characters, and weighted by how many labelled documents each stands for.
Scoring reads every whole text.

Edge cases: a text without words, empty or null, is one passage of zeros; null labels and labels of unknown documents
are not used; a doc_id labelled twice counts its highest label; with one label value only every score is that value
(0 or 1), with none it is 0.5; a null doc_id is never held out; repeated rows get equal results; a very long text is read
whole, by itself, and encoded in runs of passages; other columns, whatever their names, are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.blocks import Words, mix, slices, words
from braidwork.llm.toxicity import labelled_sample

#: Words of a passage, and bytes that are encoded at once.
PASSAGE, RUN_BYTES = 64, 1 << 20
#: Most documents of a label value, and the characters from which on no more are drawn.
SAMPLE, SAMPLE_CHARS = 4000, 20_000_000
#: Width of a passage's representation and of the attention.
HIDDEN, GATES = 24, 12
EPOCHS, BATCH, RATE, DECAY = 40, 128, 5e-3, 1e-4


def _classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, space, control, first and further bytes beyond ASCII, each punctuation."""
    out = np.full(256, 4, np.uint8)
    out[97:123], out[65:91], out[48:58] = 0, 1, 2
    out[[9, 10, 11, 12, 13, 32]] = 3
    out[192:], out[128:192] = 5, 6
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    out[marks] = 7 + np.arange(len(marks))
    return out


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1
#: Marks that end a sentence or part of one.
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".,;:!?"])
N_FEATURES = N_CLASSES + 13


@dataclass
class Bags:
    """Features of passages, and first[r]:first[r + 1] as the passages of row r."""

    features: np.ndarray
    first: np.ndarray


def _new_in_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether each word is the first of its like in its row; words are in order of rows."""
    out = np.zeros(len(hashes), bool)
    out[np.unique(mix(hashes ^ mix(row.astype(np.uint64) + np.uint64(1))), return_index=True)[1]] = True
    return out


def _means(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.astype(float), first) / size


def _encode_run(w: Words, hashes: np.ndarray, new: np.ndarray, lo: int, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Features of consecutive passages of size words each, from word lo on."""
    hi = lo + int(size.sum())
    first = np.cumsum(size) - size
    start, end = w.start[lo:hi], w.end[lo:hi]
    passage = np.repeat(np.arange(len(size)), size)
    # bytes from the first word's start to the last one's end
    begin, stop = start[first], end[first + size - 1]
    length = stop - begin
    data = w.data[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
    of = np.repeat(np.arange(len(size)), length)
    shares = np.bincount(of * N_CLASSES + CLASS[data], minlength=len(size) * N_CLASSES).reshape(-1, N_CLASSES) / length[:, None]
    head, tail, long = CLASS[w.data[start]], w.data[end - 1], end - start
    # letters of each class up to each byte of the run
    base = int(start[0])
    kinds = CLASS[w.data[base : int(end[-1])]]
    upper, lower, other = (np.concatenate([[0], np.cumsum(k)]) for k in (kinds == 1, kinds == 0, kinds == 5))
    n_upper, n_lower, n_other = (c[end - base] - c[start - base] for c in (upper, lower, other))
    own = hashes[lo:hi]
    beside = np.zeros(hi - lo, bool)
    beside[1:] = (own[1:] == own[:-1]) & (passage[1:] == passage[:-1])
    different = np.bincount(passage[np.unique(mix(own ^ mix(passage.astype(np.uint64) + np.uint64(1))), return_index=True)[1]], minlength=len(size)) / size
    mean = _means(long, first, size)
    extra = [
        np.log(mean), np.log1p(np.sqrt(np.maximum(_means(long * long, first, size) - mean * mean, 0))), different, _means(beside, first, size), _means(new[lo:hi], first, size),
        _means(head == 1, first, size), _means((n_upper > 1) & (n_lower == 0), first, size), _means(n_upper + n_lower + n_other == 0, first, size), _means(_ENDS[tail], first, size),
        _means((CLASS[tail] >= 7) & ~_ENDS[tail], first, size), _means(long <= 3, first, size), np.log(size), np.log1p(place),
    ]
    return np.concatenate([np.sqrt(shares), np.stack(extra, axis=1)], axis=1).astype(np.float32)


def encode(column: pa.Array) -> Bags:
    """Every passage of some texts."""
    w = words(column)
    n = np.maximum(-(-w.counts // PASSAGE), 1)
    first = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(int(first[-1])) - first[row]
    size = np.minimum(w.counts[row] - place * PASSAGE, PASSAGE)
    out = np.zeros((len(row), N_FEATURES), np.float32)
    full = np.flatnonzero(size > 0)
    if len(full):
        hashes = w.hashes(lower=True)
        new = _new_in_row(hashes, w.row())
        size, place = size[full], place[full]
        lo = np.cumsum(size) - size
        # runs of passages of about RUN_BYTES, by the byte that each begins at
        run = w.start[lo] // RUN_BYTES
        for k in np.split(np.arange(len(full)), np.flatnonzero(np.diff(run)) + 1):
            out[full[k]] = _encode_run(w, hashes, new, int(lo[k[0]]), size[k], place[k])
    return Bags(out, first)


@dataclass
class AttentionModel:
    """Mean and deviation of the features, and the learned weights."""

    mean: np.ndarray
    deviation: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    gate: np.ndarray
    c: np.ndarray
    bias: np.ndarray

    def passages(self, features: np.ndarray) -> np.ndarray:
        return np.tanh((features - self.mean) / self.deviation @ self.w + self.b)

    def forward(self, features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Representations, both halves of the gate, attention weights, weighted representation and log odds."""
        h = self.passages(features)
        t, g = np.tanh(h @ self.v), _logistic(h @ self.u)
        e = (t * g) @ self.gate
        size = np.diff(first)
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), size))
        a /= np.repeat(np.add.reduceat(a, first[:-1]), size)
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return h, t, g, a, z, z @ self.c + self.bias[0]

    def gradient(self, features: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss."""
        h, t, g, a, z, s = self.forward(features, first)
        size = np.diff(first)
        ds = weight * (_logistic(s) - y)
        d = np.repeat(ds, size)[:, None] * self.c
        da = (d * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), size))
        dtg = de[:, None] * self.gate
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * d + dt @ self.v.T + dg @ self.u.T) * (1 - h * h)
        x = (features - self.mean) / self.deviation
        return {"w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "gate": (t * g).T @ de, "c": z.T @ ds, "bias": np.array([ds.sum()])}


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(bags: Bags, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> AttentionModel:
    """Adam on batches of documents, with a penalty on all weights but the biases; the same result for the same rows."""
    rng = np.random.default_rng(seed)
    f, x = bags.features.shape[1], bags.features.astype(float)

    def start(*shape: int) -> np.ndarray:
        return rng.normal(0, shape[0] ** -0.5, shape)

    share = weight / weight.sum()
    prior = float(np.clip((share * y).sum(), 1e-3, 1 - 1e-3))
    model = AttentionModel(x.mean(axis=0), x.std(axis=0) + 1e-2, start(f, HIDDEN), np.zeros(HIDDEN), start(HIDDEN, GATES), start(HIDDEN, GATES), start(GATES), start(HIDDEN), np.array([np.log(prior / (1 - prior))]))
    learned = ("w", "b", "v", "u", "gate", "c", "bias")
    m, s, step = ({k: np.zeros_like(getattr(model, k)) for k in learned} for _ in range(2)), None, 0
    one, two = m
    n, size = len(y), np.diff(bags.first)
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            rows = order[k : k + BATCH]
            first = np.concatenate([[0], np.cumsum(size[rows])])
            at = np.arange(int(first[-1])) + np.repeat(bags.first[rows] - first[:-1], size[rows])
            found = model.gradient(x[at], first, y[rows], share[rows] * n / len(rows))
            step += 1
            for name in learned:
                p, grad = getattr(model, name), found[name]
                if name not in ("b", "bias"):
                    grad = grad + DECAY * p
                one[name] = 0.9 * one[name] + 0.1 * grad
                two[name] = 0.999 * two[name] + 0.001 * grad * grad
                p -= RATE * (one[name] / (1 - 0.9**step)) / (np.sqrt(two[name] / (1 - 0.999**step)) + 1e-8)
    return model


def fit_sample(table: pa.Table) -> AttentionModel | None:
    """table: (doc_id, text, grade, total). A model, or None if there is one label value only."""
    table = table.sort_by("doc_id").combine_chunks()
    grade = table.column("grade").to_numpy()
    values, at = np.unique(grade, return_inverse=True)
    if len(values) < 2:
        return None
    parts = [encode(batch.column("text")) for batch in slices(table.select(["text"]).to_batches())]
    size = np.concatenate([np.diff(p.first) for p in parts])
    bags = Bags(np.concatenate([p.features for p in parts]), np.concatenate([[0], np.cumsum(size)]))
    weight = table.column("total").to_numpy() / np.bincount(at)[at]
    return fit(bags, (grade > 0).astype(float), weight)


def _fit_task(table: pa.Table) -> pa.Table:
    model = fit_sample(table)
    grades = table.column("grade").to_numpy()
    arrays = [] if model is None else [np.asarray(getattr(model, f.name), float) for f in fields(model)]
    return pa.table({"only": pa.array([int(grades.max() > 0)], pa.int32()), "arrays": pa.array([[a.tobytes() for a in arrays]], pa.list_(pa.binary()))})


def _model(arrays: list[bytes]) -> AttentionModel:
    shapes = [(-1,), (-1,), (-1, HIDDEN), (-1,), (HIDDEN, GATES), (HIDDEN, GATES), (-1,), (-1,), (-1,)]
    return AttentionModel(*[np.frombuffer(a).reshape(s) for a, s in zip(arrays, shapes, strict=True)])


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality") -> DataFrame:
    """docs: (doc_id, text, ...); labels: (doc_id, label). (doc_id, held_out, score, predicted, n_passages, top_passage) of
    every document: the probability of label 1, whether it is at least a half, and the passage of most attention.

    held_out is a condition on doc_id; labels of rows that it holds for are never used."""
    out = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = labelled_sample(rows.where(~out), labels.where(~out), label, SAMPLE, SAMPLE_CHARS)
    found = sample.withColumn("one_task", F.lit(0)).groupBy("one_task").applyInArrow(_fit_task, "only int, arrays array<binary>").collect()
    arrays = [bytes(a) for a in found[0]["arrays"]] if found else []
    constant = float(found[0]["only"]) if found else 0.5
    sent = docs.sparkSession.sparkContext.broadcast(arrays)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent.value) if sent.value else None
        for batch in slices(batches):
            bags = encode(batch.column("text"))
            n = np.diff(bags.first)
            p, top = np.full(len(n), constant), np.zeros(len(n), np.int64)
            if model is not None:
                _, _, _, a, _, s = model.forward(bags.features, bags.first)
                p = _logistic(s)
                order = np.lexsort((np.arange(len(a)), -a, np.repeat(np.arange(len(n)), n)))
                top = order[bags.first[:-1]] - bags.first[:-1]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(top.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "n_passages", "top_passage"])

    return rows.withColumn("held_out", out).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, n_passages long, top_passage long")
