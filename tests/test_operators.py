import itertools
import random

import pytest

from braidwork import config
from braidwork.operators import graphs, runs, sequences
from braidwork.operators.chains import contacts, family_pairs


def test_contacts_equal_all_pairs(spark):
    rng = random.Random(1)
    rows = [(c, r, *(rng.uniform(-9, 9) for _ in range(3))) for c in range(4) for r in range(40)]
    got = {tuple(r) for r in contacts(spark.createDataFrame(rows, "chain int, res int, x double, y double, z double")).collect()}
    want = {(a[0], a[1], b[1]) for a, b in itertools.product(rows, rows) if a[0] == b[0] and b[1] >= a[1] + 3 and sum((a[k] - b[k]) ** 2 for k in (2, 3, 4)) <= 4.5**2}
    assert got == want and want


def test_pairs_of_a_large_family_are_formed_once(spark):
    df = spark.createDataFrame([(i, i % 10 == 0) for i in range(100)], "chain int, family boolean")
    got = [(r.a_chain, r.b_chain) for r in family_pairs(df, tile=7).collect()]
    assert len(got) == len(set(got)) == 10 * 9 // 2 + 90 * 89 // 2 and all(a > b for a, b in got)


def greedy(docs, thr=0.95):
    first = {}
    for i, t in docs:
        w = tuple((t or "").split())
        if w:
            first.setdefault(w, i)
    out, leads = {}, []
    for w, i in sorted(first.items(), key=lambda x: x[1]):
        for lw, li in leads:
            if sum(a == b for a, b in zip(w, lw, strict=False)) > thr * min(len(w), len(lw)):
                out[i] = li
                break
        else:
            leads.append((w, i))
            out[i] = i
    return out


def test_leaders_equal_a_greedy_scan(spark):
    rng = random.Random(2)
    docs = []
    for _ in range(40):
        base = [f"w{rng.randint(0, 50)}" for _ in range(rng.choice([3, 9, 25, 60, 120]))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = f"v{rng.randint(0, 9)}"
            docs.append(" ".join(own[: rng.choice([len(own), len(own), max(1, len(own) // 2)])]))
    rng.shuffle(docs)
    rows = [*enumerate(docs), (900, None), (901, "")]
    got = {r.seq: r.leader for r in sequences.leader_clusters(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == greedy(rows)


def test_graph_operators(spark):
    rng = random.Random(3)
    links = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(40)})
    near = {v: {b if a == v else a for a, b in links if v in (a, b)} for v in range(14)}
    df = spark.createDataFrame(links, "a long, b long")
    cliques = [set(q) for n in range(3, 9) for q in itertools.combinations(range(14), n) if all(y in near[x] for x, y in itertools.combinations(q, 2))]
    want = {",".join(map(str, sorted(q))) for q in cliques if not any(q < p for p in cliques)}
    got = [r.nodes for r in graphs.maximal_cliques(df).collect()]
    assert sorted(got) == sorted(want)
    tri = {v: sum(1 for x, y in itertools.combinations(near[v], 2) if y in near[x]) for v in near}
    assert {r.node: r.triangles for r in graphs.triangles(df).collect()} == {v: n for v, n in tri.items() if n}


def test_runs_with_nulls(spark):
    rows = [("u", 1, "a"), ("u", 2, "a"), ("u", 3, None), ("u", 4, None), ("u", 5, "b"), ("v", 1, "b")]
    df = spark.createDataFrame(rows, "k string, t int, s string")
    assert [r.run for r in runs.with_runs(df, "k", ["t"], "s").orderBy("k", "t").collect()] == [1, 1, 2, 2, 3, 1]
    sizes = spark.createDataFrame([(i, i % 5) for i in range(0, 3000, 7)], "k int, n int")
    total, want = 0, {}
    for r in sorted(sizes.collect()):
        want[r.k], total = total, total + r.n
    assert {r.k: r.offset for r in runs.offsets(sizes, "k", "n", "k", buckets=16).collect()} == want


def test_arguments():
    c, warnings = config.from_arguments(["-seq", "a.fas", "-seq_thr", "0.9", "-print_sim", "-bogus", "-ali_tm", "-out", "x"])
    assert (c.seq, c.seq_thr, c.print_sim, c.name) == ("a.fas", 0.9, True, "x") and warnings == ["unknown argument -bogus"]
    with pytest.raises(ValueError, match="needed"):
        config.from_arguments(["-print_sim"])
    c, _ = config.from_arguments(["-ali", "m.aln", "-seq", "a.fas"])
    assert c.ali == "m.aln" and c.seq is None
    c, warnings = config.from_parameters({"NORM": "MAX", "PDBEXT": ".ent", "ZZZ": "1"})
    assert c.norm == "max" and c.pdbext == ".ent" and warnings == ["unknown parameter ZZZ"]


def test_first_fit_equals_a_scan_in_order(spark):
    rng = random.Random(4)
    links = {(i, j) for i in range(1, 120) for j in rng.sample(range(i), min(i, rng.randint(0, 2)))} | {(i, i - 1) for i in range(121, 160)}
    want: dict[int, int] = {}
    for node in range(160):
        earlier = [j for i, j in links if i == node]
        want[node] = want[min(earlier)] if earlier else node
    nodes = spark.range(160).withColumnRenamed("id", "node")
    got = graphs.first_fit(nodes, spark.createDataFrame(sorted(links), "i long, j long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == 160
    assert graphs.first_fit(nodes.limit(0), spark.createDataFrame([], "i long, j long")).collect() == []
