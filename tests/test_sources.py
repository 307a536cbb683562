import gzip

import pytest
from pyspark.sql import functions as F

from braidwork.functions import scores
from braidwork.sources import lists, sinks, structures


def atom(no, name, code, chain, label, x, y, z, alt=" ", hetero=False, insertion=" "):
    return f"{'HETATM' if hetero else 'ATOM  '}{no:5d}  {name:<3s}{alt}{code:>3s} {chain}{label:4d}{insertion}   {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00           {name[0]}  "


@pytest.fixture
def scanned(spark, tmp_path):
    lines = [
        "EXPDTA    SOLUTION NMR", "REMARK 350 AUTHOR DETERMINED BIOLOGICAL UNIT: DIMERIC", "MODRES 1XYZ MSE A    3  MET  SELENOMETHIONINE",
        "SEQRES   1 A    5  LYS ALA MSE GLY SER", "HELIX    1   1 LYS A    1  ALA A    2  1", "SHEET    1   A 2 MSE A   3  GLY A   4  0",
        atom(1, "N", "LYS", "A", 1, 0, 0, 0), atom(2, "CA", "LYS", "A", 1, 1, 0, 0), atom(3, "H", "LYS", "A", 1, 9, 9, 9),
        atom(4, "N", "ALA", "A", 2, 2, 0, 0), atom(5, "CA", "ALA", "A", 2, 3, 0, 0, alt="A"), atom(6, "CA", "ALA", "A", 2, 30, 0, 0, alt="B"),
        atom(7, "N", "MSE", "A", 3, 4, 0, 0, hetero=True), atom(8, "CA", "MSE", "A", 3, 5, 0, 0, hetero=True),
        atom(9, "N", "GLY", "A", 4, 6, 0, 0), atom(10, "N", "GLY", "A", 4, 6.1, 0, 0, insertion="A"), "TER",
        atom(11, "O", "HOH", "A", 90, 7, 0, 0, hetero=True), atom(12, "CA", "SER", "B", 1, 8, 0, 0), atom(13, "P", "DA", "C", 1, 8, 5, 0), "ENDMDL",
        atom(14, "CA", "TRP", "D", 1, 8, 0, 0),
    ]
    with gzip.open(tmp_path / "1xyz.pdb.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    return structures.scan(structures.read_texts(spark, str(tmp_path)))


def test_structure_rules(scanned):
    got = sorted((r.chain, r.res_idx, r.label, r.aa, r.x) for r in scanned.residues.collect())
    assert got == [("A", 0, "1", "K", 1.0), ("A", 1, "2", "A", 3.0), ("A", 2, "3", "M", 5.0), ("A", 3, "4", "G", 6.0), ("B", 0, "1", "S", 8.0)]
    f = scanned.files.first()
    assert (f.file, f.method, f.oligomer) == ("1xyz", "N", 2)
    ss = {(r.chain, r.res_idx): r.ss for r in structures.secondary_structure(scanned).collect()}
    assert [ss["A", k] for k in range(4)] == ["H", "H", "E", "E"] and ss["B", 0] == " "
    pos = sorted((r.res_idx, r.pos) for r in structures.seqres_positions(scanned).collect())
    assert pos == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_lists(spark):
    rows = [(0, "# comment"), (1, "4rwu A 4-84,90-95 4rwuA00 1"), (2, "1fpo A 1-79"), (3, "2xyz")]
    got = lists.parse_list(spark.createDataFrame([("f", *r) for r in rows], "file string, no int, line string")).orderBy("no").collect()
    assert [(r.code, r.chain.strip(), r.domname, r.dir) for r in got] == [("4rwu", "A", "4rwuA00", 1), ("1fpo", "A", "1fpoA", 1), ("2xyz", "", "2xyz", 1)]
    assert [(f.ini, f.end) for f in got[0].frags] == [(4, 84), (90, 95)]
    bad = spark.createDataFrame([("f", 1, "4rwu A 4-84-9")], "file string, no int, line string")
    with pytest.raises(Exception, match="not a domain"):
        lists.parse_list(bad).collect()


def test_fasta_and_alignment(spark):
    text = ">1awj\nKKPL--\nPP\n# note\n>1bb9_B\nKK--LP\n>2abc A 1-9 2\nK-\n"
    got = lists.parse_fasta(spark.createDataFrame([("f", text)], "file string, text string"), aligned=True).orderBy("row").collect()
    assert [(r.name, r.code, r.chain.strip(), r.dir, r.seq) for r in got] == [("1awj", "1awj", "", 1, "KKPL--PP"), ("1bb9_B", "1bb9", "B", 1, "KK--LP--"), ("2abc", "2abc", "A", 2, "K-------")]
    cells = lists.msa_rows(spark.createDataFrame([("f", 1, "A--C"), ("f", 2, "-- G")], "file string, row int, seq string").withColumn("seq", F.replace("seq", F.lit(" "), F.lit("-")))).collect()
    assert sorted((r.row, r.col, r.res, r.aa) for r in cells) == [(1, 0, 0, "A"), (1, 1, 1, "C"), (2, 1, 0, "G")]


def test_similarities_matrix_and_parameters(spark):
    def lines(*text):
        return spark.createDataFrame([("f", k, t) for k, t in enumerate(text)], "file string, no int, line string")

    names = spark.createDataFrame([(1, "1abcA00"), (2, "2xyzB00")], "id int, name string")
    sim = lists.similarity_of(names, lists.parse_similarities(lines("# x", "1abcA99 2xyzB11 0.5", "1abcA 2xyzB 0.9")))
    assert sorted(map(tuple, sim.collect())) == [(1, 2, 0.5), (2, 1, 0.5)]
    matrix = lists.parse_matrix(lines("! note", "A R N", "A 4 -1 -2", "R -1 5 0"))
    assert {(r.a, r.b): r.s for r in matrix.collect()}["R", "N"] == 0.0
    assert {r.key: r.value for r in lists.parse_parameters(lines("NORM=MAX", "# A=1", "NORM=MIN")).collect()} == {"NORM": "MIN"}


def test_file_resolution(spark):
    entries = spark.createDataFrame([(1, "1abc", 1), (2, "2xyz_A", 1), (3, "9zzz", 1)], "entry_id int, code string, dir int")
    files = spark.createDataFrame([("d/1abc.pdb",), ("d/1abc",), ("d/2xyz.pdb",)], "path string")
    assert {r.entry_id: r.path for r in lists.resolve_files(entries, files).collect()} == {1: "d/1abc.pdb", 2: "d/2xyz.pdb", 3: None}


def test_columns(spark):
    one = spark.range(1)
    row = one.select(scores.leading_number(F.lit("12A")).alias("a"), scores.leading_number(F.lit("-3")).alias("b"), scores.path_stem(F.lit("/x/y.tar.gz")).alias("c"), scores.tm_scale2(F.lit(15.0)).alias("d"), scores.divergence(F.lit(1.0), 0.05).alias("e"), scores.divergence(F.lit(0.05), 0.05).alias("f"), scores.ungapped(F.lit("A--C")).alias("g"), scores.equivalent(F.lit("X"), F.lit("A")).alias("h")).first()
    assert tuple(row) == (12, None, "y.tar", None, 0.0, 10.0, "AC", True)


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, 2, 0.5), (1, 3, 1.0), (2, 3, 0.25)], "i int, j int, d double")
    assert [r.line for r in sinks.square_matrix(d, [1, 2, 3]).collect()] == ["3", "1 0.0000 0.5000 1.0000", "2 0.5000 0.0000 0.2500", "3 1.0000 0.2500 0.0000"]
    rows = spark.createDataFrame([("a", "K" * 65)], "name string, seq string")
    sinks.write_lines(sinks.fasta(rows, "name", "seq"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == [">a", "K" * 60, "K" * 5]
    msa = spark.createDataFrame([("a", 0, "K"), ("a", 2, "L"), ("b", 1, "P")], "name string, col int, aa string")
    assert {r.name: r.seq for r in sinks.aligned_fasta(msa).collect()} == {"a": "K-L", "b": "-P-"}
    text = sinks.models(spark.createDataFrame([(2, 0, "ALA", 1.0, 2.0, 3.0)], "model int, res int, code string, x double, y double, z double")).first().text
    assert text.startswith("MODEL        2\nATOM      1  CA  ALA A   1       1.000   2.000   3.000")
