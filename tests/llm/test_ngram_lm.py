import math
import random
import zlib
from collections import Counter

import numpy as np
from helpers import rows_of
from pyspark.sql import functions as F

from braidwork.llm import ngram_lm

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def toks(text):
    return (text or "").encode().translate(_LOWER).split() + [None]


def score(df):
    fold = F.crc32(F.col("doc_id").cast("string")) % 10
    return ngram_lm.score_documents(df, fold == 0, fold == 1)


def check_base(rows, got):
    folds = [zlib.crc32(str(r[0]).encode()) % 10 if r[0] is not None else None for r in rows]
    c = Counter(t for f, r in zip(folds, rows, strict=True) if f != 0 for t in toks(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), f == 0, len(toks(r[1])), sum(c[t] > 0 for t in toks(r[1])), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in toks(r[1])), 5)) for f, r in zip(folds, rows, strict=True))
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got)
    assert [w[:5] for w in want] == [h[:5] for h in have]
    assert np.allclose([w[5] for w in want], [h[5] for h in have], rtol=1e-6)


def context_bucket(n):
    return max(n, 0) if n < 8 else 8 + int(math.log2(n / 8))


def brute_scores(rows, weights, delete):
    """log10 probability of each text by the model, from counters of plain words; training documents without the token itself
    if delete."""
    folds = [zlib.crc32(str(r[0]).encode()) % 10 if r[0] is not None else None for r in rows]
    one, two, three, vocabulary, documents = Counter(), Counter(), Counter(), set(), 0
    for f, r in zip(folds, rows, strict=True):
        if f != 0:
            t = ["<", "<", *toks(r[1])]
            documents += 1
            one.update(t[2:])
            two.update(zip(t[1:], t[2:], strict=False))
            three.update(zip(t, t[1:], t[2:], strict=False))
    one["<"] = two["<", "<"] = documents
    total, vocabulary = sum(one.values()) - documents, len(one) - 1
    out = []
    for f, r in zip(folds, rows, strict=True):
        t, less, s = ["<", "<", *toks(r[1])], int(delete and f != 0), 0.0
        for u, v, w in zip(t, t[1:], t[2:], strict=False):
            h3, h2 = two[u, v] - less, one[v] - less
            ratio = [c / h if h > 0 else 0.0 for c, h in ((three[u, v, w] - less, h3), (two[v, w] - less, h2), (one[w] - less, total - less))]
            bucket = context_bucket(h3) if h3 > 0 else ngram_lm.BUCKETS + context_bucket(h2)
            s += math.log10(sum(a * b for a, b in zip(weights[bucket], [*ratio, 1 / (vocabulary + 1)], strict=True)))
        out.append(s)
    return out


def test_scores_equal_those_of_plain_counters(frame, monkeypatch, odd_texts):
    for name, value in (("BLOCK_BYTES", 3000), ("PAIR_BYTES", 2000), ("WORD_BYTES", 5000)):
        monkeypatch.setattr(ngram_lm, name, value)
    learned, learn = [], ngram_lm.learn_weights
    monkeypatch.setattr(ngram_lm, "learn_weights", lambda *a: learned.append(learn(*a)) or learned[-1])
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["red", "Green", "blue", "dark", f"w{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    rows = rows_of([*texts, *texts[:40], *(t for t in odd_texts if not t or len(t) < 1000)])
    got = {r.doc_id: r for r in score(frame(rows)).collect()}
    assert np.allclose([got[r[0]].score for r in rows], brute_scores(rows, learned[0], delete=False), rtol=1e-9)
    assert np.allclose([got[r[0]].deleted_score for r in rows], brute_scores(rows, learned[0], delete=True), rtol=1e-9)
    assert all(r.score == r.deleted_score for r in got.values() if r.held_out)
    assert np.allclose(learned[0].sum(axis=1), 1)


def test_documents_that_occur_twice_score_apart(frame):
    rng = random.Random(9)
    texts = [" ".join(f"w{min(rng.randint(0, 300), rng.randint(0, 300))}" for _ in range(60)) for _ in range(600)]
    rows = rows_of([*texts, *texts[:60]])
    got = {r.doc_id: r.deleted_score / r.n_tokens for r in score(frame(rows)).collect()}
    held = {i for i in range(660) if zlib.crc32(str(i).encode()) % 10 == 0}
    # a pair with one copy held out shows in that copy only, one with both in none
    twice = [max(got[i], got[600 + i]) for i in range(60) if not {i, 600 + i} <= held]
    assert len(twice) > 50
    assert min(twice) > max(got[i] for i in range(60, 600))


def test_base_counts_over_many_blocks(frame, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(ngram_lm, "PAIR_BYTES", 1500)
    monkeypatch.setattr(ngram_lm, "WORD_BYTES", 3000)
    rng = random.Random(1)
    texts = []
    for _ in range(300):
        words = [rng.choice("abcdefg")]
        while rng.random() < 0.95:
            words.append(chr(97 + (ord(words[-1].lower()) - 96) % 7) if rng.random() < 0.7 else rng.choice("abcdefgABC"))
        texts.append(" ".join(words))
    rows = rows_of(texts)
    got = score(frame(rows)).collect()
    check_base(rows, got)
    # the chain of letters makes pairs tell more than single words, on held-out documents too
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_texts_repeats_and_null_ids(frame, odd_texts):
    rows = rows_of(odd_texts) + [(4, odd_texts[4], None, None, None, None, None), (None, "The end", None, None, None, None, None)]
    got = score(frame(rows)).collect()
    check_base(rows, got)
    assert all(np.isfinite([r.score, r.deleted_score]).all() for r in got)


def test_weights_by_expectation_maximisation():
    rng = np.random.default_rng(0)
    true = np.array([0.6, 0.3, 0.1])
    p = rng.random((3, 50)) ** 3
    p /= p.sum(axis=1, keepdims=True)
    x = np.array([rng.choice(50, p=p[k]) for k in rng.choice(3, 20_000, p=true)])
    w = ngram_lm.learn_weights(np.zeros(len(x), int), np.stack([p[0][x] / p[2][x], p[1][x] / p[2][x]], axis=1), np.ones(len(x)))
    assert np.allclose(w[0], true, atol=0.05) and np.allclose(w.sum(axis=1), 1)


def test_packing_round_trip():
    counts = np.array([0, 1, 254, 255, 256, 10**12])
    assert np.array_equal(ngram_lm.unpack_counts(ngram_lm.pack_counts(counts), 6), counts)
    rng = np.random.default_rng(1)
    for bits in (3, 20, 40, 57, 64):
        for n in (0, 1, 2, 1000):
            keys = np.sort(rng.integers(0, 2**bits, n, dtype=np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 2**64 - 1, n, dtype=np.uint64))
            assert np.array_equal(ngram_lm.unpack_sorted(ngram_lm.pack_sorted(keys, bits), n), keys)


def test_groups_are_ranges():
    keys = np.sort(np.random.default_rng(2).integers(0, 2**64 - 1, 5000, dtype=np.uint64))
    for n in (1, 2, 7, 100, 20_000):
        g = ngram_lm.Groups(n)
        cuts = g.cuts(keys)
        assert [c[1] for c in cuts[1:]] == [c[2] for c in cuts[:-1]] and cuts[0][1] == 0 and cuts[-1][2] == 5000
        assert all(int(keys[a]) >= int(g.low(k)) and int(keys[b - 1] - g.low(k)).bit_length() <= g.bits for k, a, b in cuts)


def test_one_row_and_empty_table(frame):
    assert score(frame([])).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = score(frame([(held, "a b", None, None, None, None, None)])).first()
    assert row.held_out and row.train_tokens == 0 and np.isfinite(row.score)
