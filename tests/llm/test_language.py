import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from braidwork.llm import language
from braidwork.llm.blocks import words


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def test_forward_backward_is_exact(monkeypatch):
    rng = np.random.default_rng(0)
    scores, t, first = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), np.array([0, 4, 4, 9])
    got = language.marginals(scores, first, t)
    for a, b in ((0, 4), (4, 9)):
        p = np.zeros((b - a, 3))
        for y in itertools.product(range(3), repeat=b - a):
            s = np.log(np.exp(t).sum(axis=0)[y[0]]) + sum(scores[a + i, y[i]] for i in range(b - a)) + sum(t[y[i - 1], y[i]] for i in range(1, b - a))
            for i in range(b - a):
                p[i, y[i]] += np.exp(s)
        assert np.allclose(got[a:b], p / p.sum(axis=1, keepdims=True))
    long_scores = rng.normal(size=(1000, 3))
    whole = language.marginals(long_scores, np.array([0, 1000]), t)
    monkeypatch.setattr(language, "CHUNK", 7)
    assert np.allclose(whole, language.marginals(long_scores, np.array([0, 1000]), t))


def _texts(n, seed):
    rng = random.Random(seed)
    parts = {"en": ["the", "ing", "th", "wh", "er", "and"], "de": ["sch", "ung", "und", "ein", "keit", "ü"], "fr": ["eau", "que", "è", "ment", "oi", "ê"]}
    return [(i, " ".join("".join(rng.choice(parts[g]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 80))), g, "s", 1, "x", 1) for i in range(n) for g in [rng.choice(list(parts))]]


def test_held_out_accuracy_and_edges(frame):
    rows = _texts(400, 1) + [(1000, None, "en", "s", 1, "x", 1), (1001, "", "en", "s", 1, "x", 1), (1002, "12 34 !?", "de", "s", 1, "x", 1), (1003, "the thing", None, "s", 1, "x", 1), (None, "und keitung", "en", "s", 1, "x", 1), (1004, "日本", "en", "s", 1, "x", 1)]
    got = language.identify(frame(rows), held_out()).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [r for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(by[r[0]].held_out for r in held)
    assert np.mean([by[r[0]].lang_pred == r[2] for r in held]) > 0.95
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "en" and by[1004].lang_pred in ("en", "de", "fr")
    assert all(0 <= r.score <= 1 for r in got)


def test_words_of_switched_text():
    rows = _texts(300, 2)
    model = language.fit(pa.array([r[1] for r in rows]), [r[2] for r in rows])
    w = words(pa.array(["the thing and whering undung einsch keitung schein theing ander"]))
    labels = [model.names[k] for k in model.label_words(w).argmax(axis=1)]
    assert labels[1:3] == ["en", "en"] and labels[4:7] == ["de", "de", "de"]


def test_no_labels_and_empty_table(frame):
    rows = [(1, "abc", None, "s", 1, "x", 1)]
    assert [tuple(r) for r in language.identify(frame(rows), held_out()).collect()] == [(1, zlib.crc32(b"1") % 3 == 1, "und", 0.0)]
    assert language.identify(frame([]), held_out()).collect() == []


def test_pair_marginals_and_their_gradient_are_exact(monkeypatch):
    rng = np.random.default_rng(1)
    scores, t, first, y = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), np.array([0, 4, 4, 9]), rng.integers(0, 3, 9)

    def weight(x, a, b, t):
        return np.exp(np.log(np.exp(t).sum(axis=0)[x[0]]) + sum(scores[a + i, x[i]] for i in range(b - a)) + sum(t[x[i - 1], x[i]] for i in range(1, b - a)))

    def loss(t):
        return sum(np.log(sum(weight(x, a, b, t) for x in itertools.product(range(3), repeat=b - a)) / weight(y[a:b], a, b, t)) for a, b in ((0, 4), (4, 9)))

    monkeypatch.setattr(language, "CHUNK", 2)
    p, right, pair = language.pair_marginals(scores, first, t)
    assert right.tolist() == [1, 2, 3, 5, 6, 7, 8]
    for a, b in ((0, 4), (4, 9)):
        want = np.zeros((b - a, 3, 3))
        for x in itertools.product(range(3), repeat=b - a):
            for i in range(1, b - a):
                want[i, x[i - 1], x[i]] += weight(x, a, b, t)
        assert np.allclose(pair[(right >= a) & (right < b)], want[1:] / want[1:].sum(axis=(1, 2), keepdims=True))
    got, step = language.transition_gradient(p, right, pair, y, first, t), 1e-5
    for i, j in itertools.product(range(3), repeat=2):
        d = np.zeros((3, 3))
        d[i, j] = step
        assert abs((loss(t + d) - loss(t - d)) / (2 * step) - got[i, j]) < 1e-6


def test_long_texts_are_sampled_like_others(frame):
    rows = [(1, "a b", "en", "s", 1, "x", 1), (2, "a " * 15_000, "en", "s", 1, "x", 1), (3, "x " * 15_000, "de", "s", 1, "x", 1)]
    got = language.labelled_sample(frame(rows), F.lit(True)).collect()
    assert sorted((r.doc_id, r.lang, len(r.text)) for r in got) == [(1, "en", 3), (2, "en", 30_000), (3, "de", 30_000)]
    # the budget ends the drawing, and leaves every language a text
    rows = [(i, "word " * 500, lang, "s", 1, "x", 1) for i, lang in enumerate(["en"] * 40 + ["de"])]
    got = language.labelled_sample(frame(rows), F.lit(True), sample=30, chars=12_000).groupBy("lang").count().collect()
    assert sorted(map(tuple, got)) == [("de", 1), ("en", 5)]
