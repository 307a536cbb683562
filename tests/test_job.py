"""A run by configuration over written structure files, and the outputs and sources it uses."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork import job
from braidwork.config import Config
from braidwork.operators import chains as ch
from braidwork.operators import conservation as co
from braidwork.operators import tables, trees
from braidwork.sources import lists, sinks, structures

NAMES = ["ALA", "GLY", "SER", "LEU", "VAL", "THR"]


def write_chain(path, x, kinds, chain="A"):
    lines = [f"ATOM  {k + 1:5d}  CA  {NAMES[t]} {chain}{k + 1:4d}    {p[0]:8.3f}{p[1]:8.3f}{p[2]:8.3f}  1.00  0.00           C  " for k, (p, t) in enumerate(zip(x, kinds, strict=True))]
    with open(path, "w") as f:
        f.write("\n".join([*lines, "TER", "END", ""]))


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("job")
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=(40, 3)) * 2, axis=0)
    kinds = rng.integers(0, 6, 40)
    for d in ("one", "two"):
        os.mkdir(root / d)
    for k in range(6):
        t = kinds.copy()
        t[rng.choice(40, 4 * k, replace=False)] = rng.integers(0, 6, 4 * k)
        write_chain(root / ("two" if k == 5 else "one") / f"p{k:03d}.pdb", x + rng.normal(size=x.shape) * 0.3 * k, t)
    write_chain(root / "two" / "p000.pdb", x * 3, kinds)  # same name, other folder
    with open(root / "list", "w") as f:
        f.write("# structures\n" + "".join(f"p{k:03d} A 1-{40 - k},{39 - k}-{39 - k} d{k} {2 if k == 5 else 1}\n".replace(f",{39 - k}-{39 - k}", "") for k in range(6)))
    return root


def test_run(spark, folders, tmp_path):
    config = Config(name="r", pdblist=str(folders / "list"), pdbdir=str(folders / "one"), pdbdir2=str(folders / "two"), print_sim=True, print_div=True, print_cv=True, print_fasta=True, print_pdb=True, si_thr=0.9, msa_rounds=3)
    out = job.run(spark, config, str(tmp_path / "out"))
    assert set(out) == {"nr.pdblist", "input.fasta", "nj.tree", "nj.seqtree", "round.tree", "prot.sim", "prot.div", "PC.div", "cv", "PCAli.fas", "PCAli.ss.msa", "summary", "models.pdb"}
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"r.{n}" for n in out)
    rows = [r.value for r in spark.read.text(str(tmp_path / "out" / "r.PCAli.fas"), lineSep="\n>").collect()]
    rows = {r.split("\n")[0].strip(">"): "".join(r.split("\n")[1:]) for r in rows}
    assert len(rows) == 6 and len({len(r) for r in rows.values()}) == 1
    given = {r.name: "".join(job.TYPES[x.aa] for x in r.residues) for r in job.read_chains(spark, config).collect()}
    assert {n: r.replace("-", "") for n, r in rows.items()} == given
    matrix = [r.value.split() for r in sorted(spark.read.text(str(tmp_path / "out" / "r.PC.div")).collect(), key=lambda r: len(r.value))]
    assert matrix[0] == ["6"] and len(matrix) == 7 and all(len(m) == 7 for m in matrix[1:])
    assert spark.read.text(str(tmp_path / "out" / "r.summary")).count() == 5
    models = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out" / "r.models.pdb")).collect())
    assert models.count("MODEL ") == 6 and models.count("ATOM") == sum(map(len, given.values()))
    assert all(r.value.endswith(";") for r in spark.read.text(str(tmp_path / "out" / "r.round.tree")).collect())
    tree = spark.read.text(str(tmp_path / "out" / "r.nj.tree")).collect()
    assert len(tree) == 1 and all(f"d{k}:" in tree[0].value for k in range(6)) and tree[0].value.endswith(";")
    assert spark.read.text(str(tmp_path / "out" / "r.prot.sim")).count() == 15
    # files are taken from the entry's own folder, domains cut
    chains = {r.name: r.residues for r in job.read_chains(spark, config).collect()}
    assert {n: len(r) for n, r in chains.items()} == {f"d{k}": 40 - k for k in range(6)}
    assert max(abs(r.x) for r in chains["d0"]) < 60
    wide = job.score_pairs(job.read_chains(spark, config), Config(norm="max")).agg(F.max("len")).first()[0]
    assert wide == 40


def test_too_few_chains_are_refused(spark, folders, tmp_path):
    with open(tmp_path / "list", "w") as f:
        f.write("p001 A\n")
    with pytest.raises(ValueError, match="fewer than two"):
        job.run(spark, Config(pdblist=str(tmp_path / "list"), pdbdir=str(folders / "one")), str(tmp_path))


def test_normalisers(spark):
    def residues(n, seed):
        return [(float(a), float(b), float(c), int(k)) for (a, b, c), k in zip(np.random.default_rng(seed).normal(size=(n, 3)), np.arange(n) % 8, strict=True)]

    chains = spark.createDataFrame([(1, 0, residues(20, 1)), (2, 0, residues(45, 2)), (3, 0, residues(10, 3)), (4, None, residues(20, 4))], "chain long, family int, residues array<struct<x:double,y:double,z:double,aa:int>>")
    got = {n: {(r.i, r.j): r for r in ch.pair_scores(chains, n).collect()} for n in ("min", "max", "mean")}
    assert [got[n][2, 1].len for n in ("min", "max", "mean")] == [20, 45, 30]
    assert got["min"][2, 1].n_ali == 1 and abs(got["max"][2, 1].n_ali - 20 / 45) < 1e-12
    assert got["min"][3, 1].tm is None and got["min"][3, 1].rmsd > 0 and len(got["min"]) == 3
    small = {n: sorted(map(tuple, f.collect())) for n, f in (("tiles", ch.pair_scores(chains)), ("again", ch.pair_scores(chains.repartition(3))))}
    assert small["tiles"] == small["again"]


def test_small_tiles_give_every_pair_once(spark, sf_dir):
    from braidwork.operators.tiles import over_pairs
    from braidwork.plans import structure

    chains = structure.score_chains(spark, sf_dir)
    rows = over_pairs(chains, ["residues"], lambda t: {"i": t.chain[t.first], "j": t.chain[t.second]}, "i long, j long", tile=7)
    assert rows.count() == rows.distinct().count() == ch.pair_scores(chains).count()


def test_missing_residues_are_put_in_place(spark):
    text = "\n".join(["REMARK 465   M RES C SSSEQI", "REMARK 465     MET A     1", "REMARK 465     GLY A     3", "ATOM      1  CA  ALA A   2       0.000   0.000   0.000", "ATOM      2  CA  SER A   4       4.000   0.000   0.000", "TER"])
    got = structures.whole_sequences(structures.scan(spark.createDataFrame([("f", text)], "file string, text string")))
    assert [(r.pos, r.aa, r.seen) for r in sorted(got.collect(), key=lambda r: r.pos)] == [(1, "M", False), (2, "A", True), (3, "G", False), (4, "S", True)]


def test_fasta_is_read_by_record(spark, tmp_path):
    (tmp_path / "a.fa").write_text("# sequences\n>1abcA one\nACD\nEF\n>2xyz_B\nGH>I\n")
    (tmp_path / "b.fa").write_text(">solo\nK\n")
    got = {r.name: (r.chain, r.seq) for r in lists.read_fasta(spark, str(tmp_path), aligned=True).collect()}
    assert got == {"1abcA": ("one", "ACDEF"), "2xyz_B": ("B", "GH>I-"), "solo": (" ", "K")} or got["2xyz_B"][1] == "GH>I-"


def test_lists_and_tables_are_written(spark):
    rows = spark.createDataFrame([("1abc", "A", "d1", 1, "1-9"), ("1abd", "B", "d2", 1, None)], "code string, chain string, domname string, seq int, domain string")
    assert sorted(r.line for r in sinks.structure_list(rows).collect()) == ["1abc A 1-9 d1 1", "1abd B - d2 1"]
    assert sinks.conformation_list(rows).count() == 2 and sinks.conformation_list(rows.limit(1)).count() == 0
    assert sinks.ratio_lines(spark.createDataFrame([("all", "x", None, None), ("few", "y", 0.5, 0.1)], "class string, what string, value double, se double")).count() == 2
    assert [r.line for r in sinks.rate_lines(spark.createDataFrame([(1, 4, 2, 0.5, 0.25)], "bin int, n long, hits long, p double, se double")).collect()] == ["1\t4\t2\t0.5000\t0.2500"]
    tree = spark.createDataFrame([(0, "((1:0.1,12:0.2):0.3,2:1,3:12);")], "family int, newick string")
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (12, "d")], "id long, name string")
    assert [r.line for r in sinks.tree_lines(tree, names).collect()] == ["((a:0.1,d:0.2):0.3,b:1,c:12);"]
    ss = spark.createDataFrame([("a", 0, "H"), ("a", 2, "C"), ("b", 1, "E")], "name string, col int, ss string")
    assert {r.name: r.seq for r in sinks.element_fasta(ss).collect()} == {"a": "H- ", "b": "-E-"}


def test_compositions_and_bands(spark):
    a = spark.createDataFrame([(1, 9, 0, 3), (1, 9, 1, 4)], "i long, j long, p int, q int")
    b = spark.createDataFrame([(9, 2, 4, 7), (9, 3, 3, 0)], "i long, j long, p int, q int")
    assert sorted(map(tuple, co.compose(a, b).collect())) == [(1, 2, 1, 7), (1, 3, 0, 0)]
    assert sorted(map(tuple, co.compose(a, b, spark.createDataFrame([(1, 2)], "i long, j long")).collect())) == [(1, 2, 1, 7)]
    v = spark.createDataFrame([(0.1,), (0.5,), (None,)], "v double")
    assert v.where(tables.in_band(F.col("v"), 0.3, 0.6)).count() == 2
    si = spark.createDataFrame([(2, 1, 0.4), (3, 1, 0.2), (3, 2, 0.05)], "i long, j long, si double")
    found = spark.createDataFrame([(0, 2, 1, 3), (0, 3, 1, 2)], "family int, i long, j long, k long")
    assert trees.related_outgroups(found, si, 0.1).count() == 0 and trees.related_outgroups(found, si, 0.05).count() == 2


def test_conformations_of_a_sequence(spark):
    def residues(shift):
        return [(float(3 * k), float(k % 3) + shift * (k % 2), 0.0, k % 8) for k in range(40)]

    kind = "chain long, family int, name string, residues array<struct<x:double,y:double,z:double,aa:int>>"
    chains = spark.createDataFrame([(1, 0, "a", residues(0.0)), (2, 0, "b", residues(9.0)), (3, 0, "c", residues(0.01)), (4, 0, "d", residues(9.01)), (5, 0, "e", residues(0.0))], kind)
    lead = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)], "chain long, leader long")
    got = {r.chain: (r.seq, r.conformation) for r in job.conformations(chains, lead, Config()).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (1, 2), 5: (5, 5)}


def test_clusters_at_any_identity(spark, folders, tmp_path):
    config = Config(name="c", pdblist=str(folders / "list"), pdbdir=str(folders / "one"), pdbdir2=str(folders / "two"), seq_thr=0.85, msa_rounds=1, clique=True, ali_ss=True)
    chains = job.read_chains(spark, config)
    lead = {r.chain: r.leader for r in job.representatives(chains, config).collect()}
    assert len(set(lead.values())) == 5  # those with 0 and 4 changes, and four others
    out = job.run(spark, config, str(tmp_path / "out"))
    assert out["nr.pdblist"].count() == 5 and out["SSAli.msa"].count() == 5
    tree = out["nj.seqtree"].collect()[0].line
    assert all(f"d{k}:" in tree for k in range(6))
    assert job.representatives(chains, Config(seq_thr=0.3)).select("leader").distinct().count() == 1
