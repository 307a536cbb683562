"""Language identification of words in code-switched text by a linear-chain conditional random field.

A word's score for a language is the sum of the weights of its features: the word itself (lexicon), its first and
last 1 to 3 bytes (affixes) and its n-grams of 2 and 3 bytes. Languages of neighbouring words are tied by learned
transition weights; forward-backward gives each word's marginals. A document's language is the one with the most
expected words, its score their share.

The field is fitted, in one task, on a bounded sample: at most SAMPLE labelled documents of each language, drawn whole by
a hash of doc_id until they hold SAMPLE_CHARS characters. The sample is cut into pieces that are spliced at random into
sequences of mixed languages, from which the transitions are learned. Every whole text is labelled.

Long texts are handled in chunks of CHUNK words: the product of a chunk's transfer matrices carries the forward and
backward messages across chunks, so the result is that of one pass over the text.

Edge cases: a text that is null or has no letter gets und and score 0; without any labelled row every text does; equal
scores go to the smaller language name; repeated rows get equal results; an empty table gives an empty result; other
columns may have any name and are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.blocks import LOWER, NOT_LETTER, Words, slices, words
from braidwork.llm.sampling import least_hashes

#: Most documents of a language, and the characters from which on no more are drawn.
SAMPLE, SAMPLE_CHARS = 250, 2_000_000
SLOTS = 1 << 17
CHUNK = 64
UNKNOWN = "und"


def _slot(hashes: np.ndarray, kind: int) -> np.ndarray:
    return ((hashes ^ np.uint64(kind * 0x9E37)) * np.uint64(0xD1B54A32D192ED03) >> np.uint64(64 - 17)).astype(np.int32)


def word_features(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, slots): one feature of each of the words, for lexicon and affixes."""
    spans, size, all_words = w.spans(lower=True), w.end - w.start, np.arange(len(w))
    yield all_words, _slot(spans.hashes(w.start, w.end), 1)
    for n in (1, 2, 3):
        at = all_words if n == 1 else np.flatnonzero(size >= n)
        yield at, _slot(spans.hashes(w.start[at], w.start[at] + n), 2 + n)
        yield at, _slot(spans.hashes(w.end[at] - n, w.end[at]), 5 + n)


def gram_features(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(byte positions, slots) of the n-grams of 2 and 3 bytes inside words."""
    data = LOWER[w.data].astype(np.uint32)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    inside = np.cumsum(inside[:-1]).astype(bool)
    two = np.flatnonzero(inside[:-1] & inside[1:]) if len(data) > 1 else np.zeros(0, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[w.start] = True
    two = two[~edge[two + 1]]
    yield two, _slot((data[two] << 8 | data[two + 1]).astype(np.uint64), 11)
    three = two[:-1][np.diff(two) == 1]
    yield three, _slot((data[three] << 16 | data[three + 1] << 8 | data[three + 2]).astype(np.uint64), 12)


def emissions(w: Words, weights: np.ndarray) -> np.ndarray:
    """Score of each word for each language; words without a letter have none."""
    out = np.zeros((len(w), weights.shape[1]), np.float32)
    if not len(w):
        return out
    for at, slots in word_features(w):
        if len(at) == len(w):
            out += weights[slots]
        else:
            out[at] += weights[slots]
    per_byte = np.zeros((len(w.data) + 1, weights.shape[1]), np.float32)
    for at, slots in gram_features(w):
        per_byte[at] += weights[slots]
    out += np.add.reduceat(per_byte, w.start, axis=0)
    out[~lettered(w)] = 0
    return out


def lettered(w: Words) -> np.ndarray:
    """Words with a byte of a letter: ASCII or beyond."""
    letters = np.concatenate([[0], np.cumsum(~NOT_LETTER[w.data])])
    return letters[w.end] > letters[w.start]


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.reshape(len(x), -1).max(axis=1), 1e-30).reshape(-1, *[1] * (x.ndim - 1))


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """P(language of word | text) by forward-backward; first[r]:first[r + 1] are the words of text r."""
    return _messages(scores, first, transitions)[0]


def pair_marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The marginals, the words that have one before them in their text, and for each of these
    P(languages of the word before it and of it | text) = forward * transition * emission * backward, scaled to sum 1."""
    p, forward, back, e = _messages(scores, first, transitions)
    inside = np.ones(len(scores), bool)
    inside[first[:-1][first[:-1] < len(scores)]] = False
    right = np.flatnonzero(inside)
    pair = forward[right - 1][:, :, None] * np.exp(transitions)[None] * (e[right] * back[right])[:, None, :]
    return p, right, pair / np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)


def _messages(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marginals, forward and backward messages and emissions of each word."""
    n, k = scores.shape
    counts = np.diff(first)
    chunks = -(-counts // CHUNK)
    start = np.concatenate([[0], np.cumsum(chunks)])
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(n) - first[row]
    place = (start[row] + at // CHUNK) * CHUNK + at % CHUNK
    m = int(start[-1])
    e = np.ones((m * CHUNK, k))
    e[place] = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60.0))
    real = np.zeros(m * CHUNK, bool)
    real[place] = True
    e, real = e.reshape(m, CHUNK, k), real.reshape(m, CHUNK)
    t = np.exp(transitions)

    product = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    for s in range(CHUNK):
        on = real[:, s]
        if not on.any():
            break
        product[on] = _scaled((product[on] @ t) * e[on, s, None, :])
    ahead, behind = np.full((m, k), 1.0 / k), np.ones((m, k))
    longest = int(chunks.max(initial=0))
    for c in range(longest - 1):
        on = start[:-1][chunks > c + 1] + c
        ahead[on + 1] = _scaled(np.einsum("mi,mij->mj", ahead[on], product[on]))
    for c in range(longest - 1):
        on = start[1:][chunks > c + 1] - 1 - c
        behind[on - 1] = _scaled(np.einsum("mij,mj->mi", product[on], behind[on]))

    forward, f = np.empty((m, CHUNK, k)), ahead
    for s in range(CHUNK):
        g = _scaled((f @ t) * e[:, s])
        f = np.where(real[:, s, None], g, f)
        forward[:, s] = f
    back, b = np.empty((m, CHUNK, k)), behind
    for s in range(CHUNK - 1, -1, -1):
        back[:, s] = b
        b = np.where(real[:, s, None], _scaled((e[:, s] * b) @ t.T), b)
    forward, back, e = (x.reshape(m * CHUNK, k)[place] for x in (forward, back, e))
    p = forward * back
    return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300), forward, back, e


@dataclass
class LanguageModel:
    names: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def label_words(self, w: Words) -> np.ndarray:
        return marginals(emissions(w, self.weights), w.first, self.transitions)

    def label_texts(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        w = words(column)
        known, p = lettered(w), self.label_words(w)
        row = w.row()[known]
        expected = np.stack([np.bincount(row, p[known, j], minlength=len(column)) for j in range(len(self.names))], axis=1)
        total = np.bincount(row, minlength=len(column))
        best = expected.argmax(axis=1)
        score = np.clip(expected[np.arange(len(column)), best] / np.maximum(total, 1), 0.0, 1.0)
        names = [self.names[b] for b in best]
        ascii_row = np.zeros(len(column), bool)
        at = np.flatnonzero(~NOT_LETTER[w.data] & (w.data < 128))
        ascii_row[np.searchsorted(w.offsets, at, side="right") - 1] = True
        for r in np.flatnonzero(~ascii_row):
            text = column[int(r)].as_py()
            if not text or not any(c.isalpha() for c in text):
                names[r], score[r] = UNKNOWN, 0.0
        return names, score


def transition_gradient(p: np.ndarray, right: np.ndarray, pair: np.ndarray, y: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Gradient of the negative log likelihood of the labels y by the transitions: expected less observed neighbours.

    The first word of a text is entered from every language alike, so it counts by the shares of its transitions."""
    k = len(transitions)
    observed = np.bincount(y[right - 1] * k + y[right], minlength=k * k).reshape(k, k)
    start = first[:-1][np.diff(first) > 0]
    entered = np.exp(transitions) / np.exp(transitions).sum(axis=0)
    return pair.sum(axis=0) - observed + entered * (p[start].sum(axis=0) - np.bincount(y[start], minlength=k))


def fit(texts: pa.Array, langs: list[str], seed: int = 5, epochs: int = 4, batch_words: int = 30_000) -> LanguageModel | None:
    """Weights that maximise the likelihood of the labels of spliced sequences (AdaGrad on mini-batches)."""
    names = sorted(set(langs))
    if not names:
        return None
    rng, k = np.random.default_rng(seed), len(names)
    w = words(texts)
    of = np.array([names.index(x) for x in langs])
    pieces = []
    for r, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
        cuts = np.unique(np.concatenate([[a], np.arange(a + int(rng.integers(5, 40)), b, 40), [b]]))
        pieces += [(int(x), int(y), int(of[r])) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y > x]
    if not pieces:
        return None
    # all features of each word as (word, slot), sorted by word
    of_word, slots = [], []
    for at, slot in word_features(w):
        of_word.append(at)
        slots.append(slot)
    for at, slot in gram_features(w):
        of_word.append(np.searchsorted(w.start, at, side="right") - 1)
        slots.append(slot)
    of_word, slots = np.concatenate(of_word), np.concatenate(slots)
    kept = lettered(w)[of_word]
    order = np.argsort(of_word[kept], kind="stable")
    of_word, slots = of_word[kept][order], slots[kept][order]
    begin = np.searchsorted(of_word, np.arange(len(w) + 1))

    weights, transitions = np.zeros((SLOTS, k)), np.zeros((k, k))
    seen_w, seen_t = np.full((SLOTS, k), 1e-6), np.full((k, k), 1e-6)
    for _ in range(epochs):
        rng.shuffle(pieces)
        at = 0
        while at < len(pieces):
            picked, labels, ends, n = [], [], [0], 0
            while at < len(pieces) and n < batch_words:
                for a, b, y in pieces[at : at + int(rng.integers(1, 5))]:
                    picked.append(np.arange(a, b))
                    labels.append(np.full(b - a, y))
                    n += b - a
                    at += 1
                ends.append(n)
            idx, y, first = np.concatenate(picked), np.concatenate(labels), np.array(ends)
            size = begin[idx + 1] - begin[idx]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            feats, owner = slots[np.repeat(begin[idx], size) + inner], np.repeat(np.arange(n), size)
            scores = np.stack([np.bincount(owner, weights[feats, j], minlength=n) for j in range(k)], axis=1)
            p, right, pair = pair_marginals(scores, first, transitions)
            error = p.copy()
            error[np.arange(n), y] -= 1
            g = np.stack([np.bincount(feats, error[owner, j], minlength=SLOTS) for j in range(k)], axis=1) / n + 1e-6 * weights
            seen_w += g * g
            weights -= 0.5 * g / np.sqrt(seen_w)
            gt = transition_gradient(p, right, pair, y, first, transitions) / n + 1e-5 * transitions
            seen_t += gt * gt
            transitions -= 0.1 * gt / np.sqrt(seen_t)
    return LanguageModel(names, weights.astype(np.float32), transitions)


def labelled_sample(docs: DataFrame, usable: Column, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, text, lang) of at most sample usable documents of each language, and no more once they hold so many
    characters; a bound that holds at every size."""
    rows = docs.where(usable & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sized = rows.groupBy("doc_id", "lang").agg(F.max(F.length("text")).alias("chars"))
    ids = least_hashes(sized, "lang", "doc_id", sample, "chars", chars).select("doc_id", "lang")
    # the sample's ids: at most sample for each language
    return rows.select("doc_id", "text", "lang").join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def _fit_sample(table: pa.Table) -> pa.Table:
    table = table.sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    model = fit(table.column("text").combine_chunks(), table.column("lang").to_pylist())
    out = [] if model is None else [("\x00".join(model.names), model.weights.tobytes(), model.transitions.tobytes())]
    return pa.Table.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.binary(), pa.binary()))], ["names", "weights", "transitions"])


def fitted(sample: DataFrame) -> LanguageModel | None:
    """The model of a bounded sample, fitted in one task; what comes back is a table of fixed size."""
    rows = sample.withColumn("one_task", F.lit(0)).groupBy("one_task").applyInArrow(_fit_sample, "names string, weights binary, transitions binary").collect()
    if not rows:
        return None
    names = rows[0]["names"].split("\x00")
    return LanguageModel(names, np.frombuffer(rows[0]["weights"], np.float32).reshape(SLOTS, len(names)), np.frombuffer(rows[0]["transitions"]).reshape(len(names), -1))


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """docs: (doc_id, text, lang). Learns from the rows that held_out does not mark; returns doc_id, held_out,
    lang_pred and score of every row."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = fitted(labelled_sample(marked, ~F.col("held_out") & F.col("doc_id").isNotNull()))
    rows = marked.select("doc_id", "held_out", "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast((model.names, model.weights, model.transitions))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*sent.value)
        for batch in slices(batches, limit=1 << 20):
            names, score = own.label_texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double")


def word_labels(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs: (doc_id, text). One row per text with its word languages and their probabilities."""
    sent = docs.sparkSession.sparkContext.broadcast((model.names, model.weights, model.transitions))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*sent.value)
        for batch in slices(batches, limit=1 << 20):
            w = words(batch.column("text"))
            p = own.label_words(w)
            names, best = np.array(own.names, object)[p.argmax(axis=1)], p.max(axis=1)
            edges = list(zip(w.first[:-1], w.first[1:], strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([names[a:b] for a, b in edges], pa.list_(pa.string())), pa.array([best[a:b] for a, b in edges], pa.list_(pa.float64()))], ["doc_id", "langs", "probabilities"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(label, "doc_id long, langs array<string>, probabilities array<double>")
