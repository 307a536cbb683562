"""Work on all pairs of a family stays in the groups of tiles: blocks, sums and what grows with pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.operators import chains as ch
from braidwork.operators import tiles
from braidwork.plans import catalog, structure

CHAINS = "chain long, family int, residues array<struct<x:double,y:double,z:double,aa:int>>"


def random_chains(spark, n, seed=0, lengths=(16, 20, 31, 5)):
    rng = np.random.default_rng(seed)
    rows = [(int(c), int(c % 2), [(*map(float, rng.normal(size=3)), int(rng.integers(8))) for _ in range(lengths[c % len(lengths)])]) for c in range(n)]
    return rows, spark.createDataFrame(rows, CHAINS)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["best_score_counts", "band_histogram", "mean_scores", "pc_divergence"])
def test_all_scores_come_from_one_pass_over_pairs(name, spark, sf_dir):
    assert plan(catalog.queries()[name](spark, sf_dir)).count("FlatMapGroups") == 1


@pytest.mark.parametrize("tile", [7, 2048])
def test_blocks_give_every_pair_once_with_its_scores(spark, tile, monkeypatch):
    monkeypatch.setattr(ch, "WIDE", tile)
    rows, df = random_chains(spark, 40)
    got = {(r.i, r.j): r for r in ch.pair_scores(df).collect()}
    pairs = {(a[0], b[0]): (a[2], b[2]) for a in rows for b in rows if a[0] > b[0] and a[1] == b[1]}
    assert set(got) == set(pairs)
    for key, (a, b) in pairs.items():
        n = min(len(a), len(b))
        scale = (1.24 * np.cbrt(n - 15.0) - 1.8) ** 2 if n > 15 and 1.24 * np.cbrt(n - 15.0) > 1.8 else None
        d2 = [sum((x - y) ** 2 for x, y in zip(u[:3], v[:3], strict=True)) for u, v in zip(a, b, strict=False)]
        want = None if scale is None else sum(1 / (1 + d / scale) for d in d2) / n
        assert got[key].tm == (want if want is None else pytest.approx(want))
        assert got[key].rmsd == pytest.approx(np.sqrt(np.mean([d if scale is None else min(d, scale) for d in d2])))
        assert got[key].si == sum(u[3] == v[3] for u, v in zip(a, b, strict=False)) / n


def test_overlaps_by_blocks_are_those_of_both_contact_sets(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 16)
    edges = structure.contact_edges(spark, sf_dir)
    sets = {}
    for r in edges.collect():
        sets.setdefault(r.chain, set()).add((r.i, r.j))
    for r in ch.contact_overlap(structure.contact_chains(spark, sf_dir), edges).limit(3000).collect():
        assert r.shared == len(sets.get(r.i, set()) & sets.get(r.j, set()))


@pytest.mark.parametrize("digits", [0, 4, 6])
def test_rounded_as_by_spark(spark, digits):
    rng = np.random.default_rng(5)
    halves = (np.arange(0, 4_000, 7) * 10 + 5) / 10.0 ** (digits + 1)
    edges = np.concatenate([halves, np.nextafter(halves, 9), np.nextafter(halves, -9)])
    values = np.concatenate([edges, rng.random(2_000), rng.normal(size=500) * 1e3, np.arange(300) / 21, 1 / np.arange(1, 300), 2.0 ** np.arange(-40, 60), 10.0 ** np.arange(-12, 25), [0.0, 1e300, 5e-324, np.nan, np.inf]])
    values = np.concatenate([values, -values])
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, v double")
    want = [r.v for r in df.select("k", F.round("v", digits).alias("v")).orderBy("k").collect()]
    got = tiles.rounded(values, digits)
    assert [repr(v) for v in got.tolist()] == [repr(v) for v in want]


@pytest.mark.parametrize("name", ["pair_scores", "contact_overlap", "best_score_counts", "band_histogram"])
def test_rows_of_pairs_are_rounded_in_their_groups(name, spark, sf_dir):
    """Spark's round of every row took most of the time."""
    shown = plan(catalog.queries()[name](spark, sf_dir))
    assert not [c for c in ("n_ali", "si", "tm", "rmsd", "co") if f"round({c}#" in shown]


def test_scores_are_rounded_as_by_spark(spark):
    _, df = random_chains(spark, 40)
    scores = ["n_ali", "si", "tm", "rmsd"]
    want = ch.pair_scores(df).select("family", "i", "j", "len", *[F.round(c, 6).alias(c) for c in scores])
    assert sorted(map(repr, ch.pair_scores(df, digits=6).collect())) == sorted(map(repr, want.collect()))


def test_residues_are_not_sent_to_find_contacts(spark, sf_dir):
    edges = structure.contact_edges(spark, sf_dir)
    assert "Join" not in plan(edges)
    by_cells = ch.contacts(ch.residue_rows(structure.contact_chains(spark, sf_dir)))
    assert edges.schema == by_cells.schema
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, by_cells.collect()))


def test_contacts_of_odd_chains_are_those_by_cells(spark):
    nan, none = float("nan"), None
    points = [(0.0, 0.0, 0.0), (nan, 0.0, 0.0), (4.5, 0.0, 0.0), (-4.5, 0.0, 0.0), (0.0, 4.4, 0.0), (none, 0.0, 0.0), (0.0, 0.0, 0.0)]
    rows = [(c, 1, [(*p, 1) for p in points[:n]]) for c, n in enumerate((0, 1, 3, 7, 7))] + [(3, 1, [(*p, 1) for p in points]), (9, None, None)]
    df = spark.createDataFrame(rows, CHAINS)
    for separation in (1, 3):
        got = sorted(map(tuple, ch.chain_contacts(df, separation=separation).collect()))
        assert got and got == sorted(map(tuple, ch.contacts(ch.residue_rows(df), separation=separation).collect()))


SUMMED = ["nearest_neighbour", "link_degree", "mean_divergence", "score_extrema", "tm_sum_columns", "distance_histogram", "adaptive_bins", "conformation_medoid", "type_propensity", "self_score"]


@pytest.mark.parametrize("name", SUMMED)
def test_sums_over_pairs_leave_a_group_as_few_rows(name, spark, sf_dir, monkeypatch):
    """What leaves the groups of tiles is far less than the pairs."""
    left = []
    over = ch.over_pairs

    def counted(*a, **k):
        left.append(over(*a, **k).count())
        return over(*a, **k)

    monkeypatch.setattr(ch, "over_pairs", counted)
    catalog.queries()[name](spark, sf_dir)
    pairs = 500 * 499 // 2 // 10
    assert left and sum(left) < pairs / 3


@pytest.mark.parametrize("tile", [7, 2048])
def test_best_links_hold_the_best_of_all(spark, tile, monkeypatch):
    monkeypatch.setattr(ch, "WIDE", tile)
    _, df = random_chains(spark, 60)
    scores = {}
    for r in ch.pair_scores(df).collect():
        if r.tm is not None:
            for a, b in ((r.i, r.j), (r.j, r.i)):
                scores.setdefault(a, []).append((-round(r.tm, 6), b))
    got = {}
    for r in ch.best_links(df, 3).collect():
        got.setdefault(r.chain, set()).add((-r.score, r.other))
    assert {c: sorted(v)[:3] for c, v in got.items()} == {c: sorted(v)[:3] for c, v in scores.items()}
