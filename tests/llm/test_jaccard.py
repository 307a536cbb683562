import random
import re

import numpy as np
import pyarrow as pa
from helpers import rows_of

from braidwork.llm import jaccard
from braidwork.llm.components import components

W = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, n=5):
    w = W.findall(text or "")
    return {tuple(w[p : p + n]) for p in range(max(len(w) - n, 0) + 1)} if w else set()


def brute(rows, threshold=0.8):
    sets = [grams(r[1]) for r in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i, r in enumerate(rows):
        seen, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        copies = [rows[j][0] for j in range(len(rows)) if sets[j] == sets[i]] if sets[i] else [r[0]]
        out.append((r[0], min(rows[j][0] for j in seen), min(copies), len(links[i])))
    return sorted(out)


def groups(rng, sizes, length=60):
    texts = []
    for size in sizes:
        base = [f"w{rng.randint(0, 400)}" for _ in range(length)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                own[rng.randrange(length)] = f"v{rng.randint(0, 9999)}"
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return texts


def classes(frame, rows):
    return sorted(tuple(r)[:4] for r in jaccard.similarity_classes(frame(rows)).collect())


def test_matches_brute_force(frame):
    rng = random.Random(1)
    rows = rows_of(groups(rng, [1] * 60 + [2] * 15 + [5, 9, 20]) + ["a b c", "a b c", "a b", "c"])
    assert classes(frame, rows) == brute(rows)


def test_splits_and_dense_buckets(frame, monkeypatch):
    monkeypatch.setattr(jaccard, "LIMIT", 6)
    monkeypatch.setattr(jaccard.choose_paths, "__defaults__", (6,))
    rng = random.Random(2)
    shared = " ".join(f"s{k}" for k in range(25))
    rows = rows_of(groups(rng, [40, 12, 1, 1, 1, 3]) + [shared + " " + t for t in groups(rng, [1] * 40, 30)])
    assert classes(frame, rows) == brute(rows)


def test_odd_texts_and_repeats(frame, odd_texts):
    rows = rows_of(odd_texts)
    rows += [rows[4], rows[5]]
    assert classes(frame, rows) == brute(rows)
    got = jaccard.similarity_classes(frame([(None, "a b c d e f", None, None, None, None, None), (3, "a b c d e f", None, None, None, None, None)])).collect()
    assert len(got) == 2 and {r.n_links for r in got} == {1}


def test_empty_table(frame):
    assert jaccard.similarity_classes(frame([])).collect() == []


def test_sets_of_texts():
    texts = ["a b c d e f", "a b c d e", "a b", None, "a b c d e a b c d e a b c d e"]
    rows, hashes = jaccard.shingle_sets(pa.array(texts))
    assert np.bincount(rows, minlength=5).tolist() == [len(grams(t)) for t in texts]
    assert hashes[rows == 1][0] in hashes[rows == 0]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    for node, root in got.items():
        seen, stack = {node}, [node]
        while stack:
            for x in near[stack.pop()]:
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        assert root == min(seen)
    assert set(got) == {x for e in edges if e[0] != e[1] for x in e}


def test_runs_count_the_losses_of_splits():
    rng = np.random.default_rng(4)
    for recall in (0.95, 0.99):
        runs, found, n = jaccard.runs_for(0.8, recall), 0, 20_000
        for agree in rng.binomial(jaccard.SKETCH, 0.8, n) / jaccard.SKETCH:
            together = (rng.random(runs) < 0.8).astype(int)
            for _ in range(jaccard._MOST_SPLITS):
                together = np.minimum(rng.binomial(2 * together, agree), 1000)
            found += bool(together.any())
        assert found / n >= recall - 0.002
    assert jaccard.missed(0.8, jaccard.runs_for(0.8, jaccard.RECALL)) <= 1 - jaccard.RECALL
