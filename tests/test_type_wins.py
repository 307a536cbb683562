"""Wins of alignment types leave the groups of tiles as counts; rotations and alignments of many pairs are those of single ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.operators import kernels, refinement
from braidwork.plans import alignment, catalog


def test_wins_are_those_of_rows_and_leave_groups_as_counts(spark, sf_dir, monkeypatch):
    r = refinement.refined(alignment.element_chains(spark, sf_dir))
    best = r.groupBy("i", "j").agg(F.max_by("type", F.struct(F.round("pc", 9), "type")).alias("type"))
    want = sorted(map(tuple, best.groupBy("type").count().collect()))
    left, over = [], refinement.over_pairs

    def counted(*a, **k):
        left.append(over(*a, **k).count())
        return over(*a, **k)

    monkeypatch.setattr(refinement, "over_pairs", counted)
    assert sorted(map(tuple, catalog.queries()["alignment_type_wins"](spark, sf_dir).collect())) == want
    assert left and sum(left) <= 5 * 10 < sum(n for _, n in want)


def test_partners_that_are_not_asked_for_are_not_sent(spark, sf_dir):
    df = catalog.queries()["pairwise_refinement"](spark, sf_dir)
    assert "partner" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_rotations_that_take_more_steps_than_most():
    rng = np.random.default_rng(1)
    easy = rng.normal(size=(3, 3)) + 3 * np.eye(3)
    s = np.stack([easy] * 20 + [rng.normal(size=(3, 3)) * 10.0**k for k in range(-3, 4)] + [np.diag([1.0, 1.0, -1.0]), np.diag([1.0, 1e-9, 1e-9])])
    rot = kernels.best_rotations(s.copy())
    u, sv, vt = np.linalg.svd(s)
    best = sv[:, 0] + sv[:, 1] + np.sign(np.linalg.det(u @ vt)) * sv[:, 2]
    assert np.einsum("nij,nij->n", rot, s) == pytest.approx(best, rel=1e-9)
    assert np.linalg.det(rot) == pytest.approx(np.ones(len(s)))


def test_alignments_of_many_pairs_are_those_of_one(monkeypatch):
    monkeypatch.setattr(refinement, "ALIGNED", 7)
    rng = np.random.default_rng(2)
    sim, la, lb = np.round(rng.normal(size=(30, 9, 12)) * 4), rng.integers(1, 10, 30), rng.integers(1, 13, 30)
    score, partner = refinement.affine_partners(sim, la, lb)
    for k in range(30):
        want, pairs = kernels.affine_path(sim[k, : la[k], : lb[k]])
        assert score[k] == pytest.approx(want)
        assert [(p, q) for p, q in enumerate(partner[k].tolist()) if q >= 0] == pairs
