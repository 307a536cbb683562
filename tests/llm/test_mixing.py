import random
import re

import numpy as np
from helpers import rows_of

from braidwork.llm import mixing

W = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def check(rows, got):
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(W.findall(r[1] or ""))
    want, taken = targets(sizes), {}
    for r in got:
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    return want, taken


def test_targets_are_met(frame):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 3, 5, 8, 40, 300])), "en", rng.choice(["a", "b", "c", "é", "B", None] + ["a"] * 6), 1, "x", 1) for i in range(900)]
    df = frame(rows)
    first = mixing.mix_sources(df).collect()
    want, taken = check(rows, first)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_odd_texts_and_repeats(frame, odd_texts):
    rows = rows_of(odd_texts) + rows_of(odd_texts, None)
    check(rows, mixing.mix_sources(frame(rows)).collect())
    assert mixing.mix_sources(frame([])).collect() == []
    assert [r.taken for r in mixing.mix_sources(frame(rows_of([None, ""]))).collect()] == [0, 0]


def test_budgets_are_fitted_exactly():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = np.unique(rng.integers(1, 400, 20))
        counts = rng.integers(1, 30, len(sizes))
        pick = rng.integers(0, counts + 1)
        budget = int((sizes * pick).sum())
        take = mixing.fit_budget(sizes, counts, budget)
        assert (take <= counts).all() and (take >= 0).all() and int((take * sizes).sum()) == budget
    big = mixing.fit_budget(np.array([10**7, 3]), np.array([5, 2]), 2 * 10**7 + 5, exact=1000)
    assert big.tolist() == [2, 1]


def test_few_long_texts_are_fitted():
    def best(sizes, counts, budget):
        sums = {0}
        for s, c in zip(sizes, counts, strict=True):
            sums = {x + k * s for x in sums for k in range(c + 1)}
        return max(x for x in sums if x <= budget)

    cases = [([1_000_000, 1_200_000], [1, 1], 1_010_000), ([200_000, 300_000, 450_001], [1, 1, 1], 660_000), ([700_000, 500_000], [2, 2], 1_400_000), ([140_000, 150_000, 7], [3, 1, 3], 430_020)]
    for sizes, counts, budget in cases:
        take = mixing.fit_budget(np.array(sizes), np.array(counts), budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert int((take * sizes).sum()) == best(sizes, counts, budget)
