import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from braidwork.llm import quality
from helpers import rows_of



def _docs(n, seed=1):
    """Prose; every fourth document has one passage of junk among good ones."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["an", "th", "er", "on", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(70, 400))]
        junk = i % 4 == 0
        if junk:
            at = rng.randint(0, len(words) - 60)
            words[at : at + 60] = rng.choice([["BUY!!", "NOW!!"] * 30, ["again"] * 60, ["x#$", "&&y"] * 30])
        docs.append((i, " ".join(words), "en", "s", 1, "x", 1))
        labels.append((i, int(not junk)))
    return docs, labels


def test_held_out_documents_are_told_apart(spark, frame):
    docs, labels = _docs(900)
    df = spark.createDataFrame(labels, "doc_id long, quality int")
    # labels of held-out rows are turned round, so a model that saw them would fail
    held = F.col("doc_id") % 3 == 1
    lied = df.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    got = {r.doc_id: r for r in quality.score_quality(frame(docs), lied, held).collect()}
    assert len(got) == 900 and all(r.held_out == (i % 3 == 1) for i, r in got.items())
    right = [got[i].predicted == q for i, q in labels if i % 3 == 1]
    assert np.mean(right) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    again = quality.score_quality(frame(docs), lied, held).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got.values()))


def _random_model(rng, f):
    return quality.AttentionModel(rng.normal(size=f), rng.random(f) + 0.5, rng.normal(size=(f, quality.HIDDEN)), rng.normal(size=quality.HIDDEN), rng.normal(size=(quality.HIDDEN, quality.GATES)), rng.normal(size=(quality.HIDDEN, quality.GATES)), rng.normal(size=quality.GATES), rng.normal(size=quality.HIDDEN), rng.normal(size=1))


def test_attention_as_in_loops_over_passages():
    rng = np.random.default_rng(0)
    m, x, first = _random_model(rng, 5), rng.normal(size=(9, 5)), np.array([0, 1, 4, 9])
    _, _, _, a, z, s = m.forward(x, first)
    for r in range(3):
        h = [np.tanh((x[k] - m.mean) / m.deviation @ m.w + m.b) for k in range(first[r], first[r + 1])]
        e = np.array([sum(m.gate[j] * np.tanh(p @ m.v[:, j]) / (1 + np.exp(-(p @ m.u[:, j]))) for j in range(quality.GATES)) for p in h])
        share = np.exp(e) / np.exp(e).sum()
        whole = sum(w * p for w, p in zip(share, h, strict=True))
        assert np.allclose(a[first[r] : first[r + 1]], share) and np.allclose(z[r], whole) and np.isclose(s[r], whole @ m.c + m.bias[0])


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    m, x, first = _random_model(rng, 4), rng.normal(size=(7, 4)), np.array([0, 2, 3, 7])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 2.0])

    def loss():
        s = m.forward(x, first)[-1]
        return (weight * (np.logaddexp(0, s) - y * s)).sum()

    found = m.gradient(x, first, y, weight)
    for name in ("w", "b", "v", "u", "gate", "c", "bias"):
        p = getattr(m, name)
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(4)]:
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert np.isclose(found[name][at], (up - down) / 2e-5, atol=1e-6)


def _shape(words, earlier):
    """Features of a passage, one by one."""
    body = " ".join(words).encode()
    shares = np.bincount(quality.CLASS[np.frombuffer(body, np.uint8)], minlength=quality.N_CLASSES) / len(body)
    size, b = np.array([len(w.encode()) for w in words]), [w.encode() for w in words]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in b]
    seen, new = set(earlier), []
    for w in low:
        new.append(w not in seen)
        seen.add(w)
    upper, lower, other = ([sum(k(c) for c in w) for w in b] for k in (lambda c: 65 <= c <= 90, lambda c: 97 <= c <= 122, lambda c: c >= 192))
    ends = [w[-1] in b".,;:!?" for w in b]
    n = len(words)
    return np.sqrt(shares), [
        np.log(size.mean()), np.log1p(size.std()), len(set(low)) / n, sum(x == y for x, y in zip(low, low[1:])) / n, np.mean(new), np.mean([65 <= w[0] <= 90 for w in b]),
        np.mean([u > 1 and not v for u, v in zip(upper, lower)]), np.mean([u + v + o == 0 for u, v, o in zip(upper, lower, other)]), np.mean(ends),
        np.mean([w[-1] < 128 and not bytes([w[-1]]).isalnum() and not e for w, e in zip(b, ends)]), np.mean(size <= 3), np.log(n),
    ], low


def test_features_as_counted_plainly(monkeypatch):
    monkeypatch.setattr(quality, "RUN_BYTES", 700)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["One", "two,", "THREE!!", "#4", "été", "x|y", "two,"]) for _ in range(n)) for n in (1, 64, 65, 300)] + ["", None]
    bags = quality.encode(pa.array(texts))
    assert bags.first.tolist() == [0, 1, 2, 4, 9, 10, 11]
    for r, t in enumerate(texts):
        words, earlier = (t or "").split(" ") if t else [], []
        for k in range(bags.first[r], bags.first[r + 1]):
            own = words[(k - bags.first[r]) * 64 : (k - bags.first[r] + 1) * 64]
            if not own:
                assert not bags.features[k].any()
                continue
            shares, extra, low = _shape(own, earlier)
            earlier += low
            assert np.allclose(bags.features[k], [*shares, *extra, np.log1p(k - bags.first[r])], atol=1e-5)


def test_edges(spark, frame, odd_texts):
    docs, labels = _docs(60)
    odd = [(1000 + i, t, None, None, None, None, None) for i, t in enumerate(odd_texts)] + [(None, "text", "en", "s", 1, "x", 1)]
    df = spark.createDataFrame([*labels, (1, 1), (1, 0), (None, 1), (2, None), (5000, 1)], "doc_id long, quality int")
    got = quality.score_quality(frame(docs + odd + docs[:3]), df, F.col("doc_id") % 3 == 1).collect()
    assert len(got) == 60 + len(odd) + 3 and all(np.isfinite(r.score) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert len({r.score for r in got if r.doc_id in (1000, 1001, 1002)}) == 1
    for rows, want in (([], 0.5), ([(1, 1)], 1.0), ([(1, 0)], 0.0)):
        one = spark.createDataFrame(rows, "doc_id long, quality int")
        assert {r.score for r in quality.score_quality(frame(docs), one, F.lit(False)).collect()} == {want}
    assert quality.score_quality(frame([]), df, F.lit(False)).collect() == []
    assert quality.score_quality(frame(rows_of(odd_texts)), df, F.lit(False)).count() == len(odd_texts)
