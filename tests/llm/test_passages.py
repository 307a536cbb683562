import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from braidwork.llm import passages
from braidwork.llm.blocks import Spans, words
from helpers import rows_of

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    toks = [(i, W.findall(t or "")) for i, t, *_ in rows]
    least = {}
    for i, w in toks:
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, w in toks:
        cut = set()
        if i is not None:
            for p in range(len(w) - window + 1):
                if least[tuple(w[p : p + window])] < i:
                    cut |= set(range(p, p + window))
        kept = [x for k, x in enumerate(w) if k not in cut]
        out.append((i, len(w), len(cut), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def check(frame, rows, window, anchor):
    got = passages.remove_repeats(frame(rows), window, anchor).drop("repeats").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, window)


def test_random_documents_with_shared_passages(frame):
    rng = random.Random(5)
    pool = [[rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(8, 60))] for _ in range(12)]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pool) if rng.random() < 0.7 else [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 30))]
            a = rng.randint(0, len(p))
            parts += p[a:] if rng.random() < 0.3 else p
        texts.append(" ".join(parts))
    rng.shuffle(texts)
    check(frame, rows_of(texts), 12, 4)


def test_repeated_words_and_hot_passage(frame):
    rng = random.Random(6)
    hot = [f"h{k}" for k in range(40)]
    texts = ["a " * 60, "a b " * 40, "a " * 80] + [" ".join([f"x{rng.randint(0, 99)}" for _ in range(rng.randint(0, 9))] + hot + [f"y{rng.randint(0, 99)}" for _ in range(5)]) for _ in range(120)]
    check(frame, rows_of(texts), 10, 4)


def test_hot_keys_are_joined_in_parts(frame, monkeypatch):
    monkeypatch.setattr(passages, "HOT_SHARE", 5)
    monkeypatch.setattr(passages, "PARTS", 7)
    rng = random.Random(11)
    hot = [f"h{k}" for k in range(14)]
    texts = [" ".join([f"x{rng.randint(0, 5)}" for _ in range(rng.randint(0, 30))] + hot + [f"y{rng.randint(0, 5)}" for _ in range(9)]) for _ in range(90)]
    check(frame, rows_of(texts + texts[:30] + [texts[0]] * 40), 12, 4)


def test_odd_texts_repeats_and_null_ids(frame, odd_texts):
    rows = rows_of(odd_texts)
    rows += [rows[4], (None, odd_texts[4], None, None, None, None, None), (4, "other " * 70, None, None, None, None, None)]
    check(frame, rows, 50, 12)


def test_equal_first_hashes_do_not_match(frame, monkeypatch):
    """Runs of words whose first hash is one and the same are still told apart by the second."""

    class Blind:
        def __init__(self, values):
            self.n = len(values)

        def hashes(self, start, end):
            return np.zeros(len(start), np.uint64)

    rng = random.Random(9)
    w = words(pa.array([" ".join(f"w{rng.randint(0, 9)}" for _ in range(80)) for _ in range(2)]))
    plain = passages.segments(w, 12, 4)
    monkeypatch.setattr(passages, "run_hashes", lambda h: (Blind(h), Spans(h)))
    row, first, n, anchor, segment, second = passages.segments(w, 12, 4)
    assert len(row) > 1 and not segment.any() and len(set(second.tolist())) == len(row)
    assert len(set(zip(plain[4].tolist(), plain[5].tolist()))) == len(plain[0])


def test_empty_table(frame):
    assert passages.remove_repeats(frame([])).collect() == []
