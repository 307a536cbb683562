import random

import numpy as np
import pyarrow as pa

from braidwork.llm import toxicity


def _rows(n, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["an", "th", "er", "on", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randint(1, 5)):
                words.insert(rng.randint(0, len(words)), rng.choice(["Vile,", "vile", "gross", "awful."]))
        docs.append((i, " ".join(words), "en", "s", 1, "x", 1))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxic_documents_are_found(spark, frame):
    docs, labels = _rows(600)
    half = [x for x in labels if x[0] < 400]
    got = {r.doc_id: r for r in toxicity.score_severity(frame(docs), spark.createDataFrame(half, "doc_id long, toxic int")).collect()}
    assert len(got) == 600
    assert all(got[i].toxic == bool(t) for i, t in labels)
    assert all(0 <= r.expected_severity <= 2 for r in got.values())
    assert "member" in got[0].asDict()


def test_ordered_thresholds_recover_grades():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, 3000)
    y = np.clip((x + rng.normal(0, 0.5, 3000)) // 2, 0, 2).astype(int)
    w, theta = toxicity.fit_thresholds(np.arange(3000), np.zeros(3000, int), x.astype(float), 1, y, np.ones(3000))
    assert w[0] > 0 and theta[0] < theta[1]
    model = toxicity.OrdinalModel(np.array([1], np.uint64), w, theta)
    e = model.expected(np.arange(6) * w[0])
    assert (np.diff(e) > 0).all() and e[0] < 0.3 and e[5] > 1.7


def test_edges(spark, frame, odd_texts):
    docs, labels = _rows(100)
    odd = [(1000 + i, t, None, None, None, None, None) for i, t in enumerate(odd_texts)] + [(None, "vile", "en", "s", 1, "x", 1)]
    extra = [(1, 1), (1, 0), (None, 1), (2, None), (5000, 1)]
    df = spark.createDataFrame([*labels, *extra], "doc_id long, toxic int")
    got = toxicity.score_severity(frame(docs + odd + docs[:3]), df).collect()
    assert len(got) == 100 + len(odd) + 3
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.toxic for r in toxicity.score_severity(frame(docs), none).collect()} == {False}
    assert toxicity.score_severity(frame([]), df).collect() == []


def test_three_label_values():
    texts = pa.array(["good day"] * 50 + ["bad day"] * 50 + ["awful bad day"] * 50)
    model = toxicity.fit(pa.table({"text": texts, "grade": [0] * 50 + [1] * 50 + [2] * 50}), {0: 50, 1: 50, 2: 50})
    e = model.expected(model.sums(pa.array(["good day", "bad day", "awful bad day"])))
    assert e[0] < 0.5 < e[1] < 1.5 < e[2]


def test_likely_clean_documents_stay(spark, frame):
    # of the texts with 0, 1, 2, 3 and 4 bad words 0, 8, 45, 80 and 96 % are labelled toxic
    bad, share, rows = ["vile", "ugly", "foul", "mean", "sick"], [0, 8, 45, 80, 96], []
    for k in range(5):
        for m in range(600 if k == 2 else 100):
            rows.append((len(rows), " ".join(["a day", *[bad[(m + x) % 5] for x in range(k)]]), k, int(m * 37 % 100 < share[k])))
    labels = spark.createDataFrame([(i, t) for i, _, _, t in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_severity(frame([(i, x, "en", "s", 1, "x", 1) for i, x, _, _ in rows]), labels).collect()}
    assert not any(got[i].toxic for i, _, k, _ in rows if k <= 2)
    assert all(got[i].toxic for i, _, k, _ in rows if k >= 3)
    assert max(r.expected_severity for r in got.values()) > 1


def test_fit_is_the_minimum_of_the_penalised_loss():
    rng = np.random.default_rng(3)
    n, f = 300, 4
    dense = rng.integers(0, 3, (n, f)).astype(float)
    y = np.clip(np.rint(dense @ np.array([1.0, -1.0, 0.5, 0.0]) / 2 + rng.normal(0, 0.8, n)), 0, 2).astype(int)
    weight = rng.random(n) + 0.5
    rows, cols = np.nonzero(dense)
    penalty = 1e-3
    w, theta = toxicity.fit_thresholds(rows, cols, dense[rows, cols], f, y, weight, penalty=penalty, steps=4000)

    def loss(w, theta):
        below = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-(theta[None] - (dense @ w)[:, None]))), np.ones((n, 1))], axis=1)
        p = below[np.arange(n), y + 1] - below[np.arange(n), y]
        return -(weight / weight.sum() * np.log(p)).sum() + penalty / 2 * (w**2).sum() / f**0.5

    best = loss(w, theta)
    for k in range(f + 2):
        for step in (-0.02, 0.02):
            moved = np.concatenate([w, theta])
            moved[k] += step
            assert loss(moved[:f], moved[f:]) > best - 1e-7


def test_expected_severity_sums_over_grades():
    model = toxicity.OrdinalModel(np.array([1], np.uint64), np.array([1.0]), np.array([-0.5, 0.7, 2.0]))
    s = np.linspace(-3, 3, 7)
    below = np.concatenate([np.zeros((7, 1)), 1 / (1 + np.exp(-(model.thresholds[None] - s[:, None]))), np.ones((7, 1))], axis=1)
    p = np.diff(below, axis=1)
    assert np.allclose(model.expected(s), p @ np.arange(4)) and np.allclose(model.positive(s), 1 - p[:, 0])


def test_weak_grades_follow_the_number_of_telling_words():
    rng = np.random.default_rng(4)
    clean = [" ".join(rng.choice(["sun", "rain", "tree", "lake"], 20)) for _ in range(200)]
    bad = [" ".join(["vile", "foul"] * (1 if k % 2 else 6)) + " " + clean[k] for k in range(80)]
    texts = pa.table({"text": clean + bad, "grade": [0] * 200 + [1] * 80})
    model = toxicity.fit(texts, {0: 200, 1: 80})
    assert len(model.thresholds) == 2
    e = model.expected(model.sums(pa.array(bad)))
    assert min(e[0::2]) > max(e[1::2])


def test_long_labelled_documents_take_part(spark, frame):
    docs, labels = _rows(60)
    docs = [(i, t + " pad" * 20_000, *rest) for i, t, *rest in docs]
    assert toxicity.labelled_sample(frame(docs), spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic").count() == 60
    few = toxicity.labelled_sample(frame(docs), spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", chars=100_000).groupBy("grade").count().collect()
    assert sorted(map(tuple, few)) == [(0, 2), (1, 2)]
