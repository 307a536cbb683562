import gzip
import random
import re

import pytest
from pyspark.sql import functions as F
from test_sources import atom

from braidwork.sources import reader, structures

NAMES = ("N", "CA", "CB", "H", "O", "P")
CODES = ("LYS", "ALA", "MSE", "GLY", "SER", "DA", "XYZ", "HOH")


def random_file(rng):
    """Chains that alternate and close, labels that repeat, alternates, insertions near and far, ligands, odd records."""
    lines = ["MODRES 1XYZ MSE A    3  MET  SELENOMETHIONINE", "MODRES 1XYZ MSE A    9  GLY  AGAIN"] if rng.random() < 0.7 else []
    lines += [f"SEQRES   {k} {c}    5  " + " ".join(rng.choice(CODES) for _ in range(rng.randint(0, 9))) for k in (1, 2) for c in "AB"]
    lines += ["HELIX    1   1 LYS A    1  ALA A    2  1", "SHEET    1   A 2 MSE B   3  GLY B   4  0", "", "short", "ATOM"][: rng.randint(0, 5)]
    label, chain = 1, "A"
    for no in range(rng.randint(0, 60)):
        label += rng.random() < 0.4
        chain = rng.choice("ABC") if rng.random() < 0.1 else chain
        place = [round(rng.uniform(0, 2), 3) for _ in range(3)]
        line = atom(no, rng.choice(NAMES), rng.choice(CODES), chain, label, *place, alt=rng.choice("    AB"), hetero=rng.random() < 0.2, insertion=rng.choice("    AB"))
        lines.append(line if rng.random() < 0.95 else line[: rng.randint(20, 50)])
        if rng.random() < 0.05:
            lines.append(rng.choice(["TER", "ENDMDL", "REMARK"]))
    return "\n".join(lines) + rng.choice(["", "\n", "\n\n"])


@pytest.fixture
def folder(spark, tmp_path):
    reader.register(spark)
    rng = random.Random(4)
    for k in range(40):
        text, inner = random_file(rng), tmp_path / ("a" if k % 2 else "b/c")
        inner.mkdir(parents=True, exist_ok=True)
        if k % 3:
            (inner / f"s{k}.{'pdb' if k % 2 else 'ent'}").write_text(text)
        else:
            (inner / f"s{k}.pdb.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "empty.pdb").write_text("")
    (tmp_path / "empty2.pdb.gz").write_bytes(b"")
    (tmp_path / "_hidden.pdb").write_text(atom(1, "CA", "LYS", "A", 1, 0, 0, 0))
    return str(tmp_path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def load(spark, folder, **options):
    return spark.read.format("structure").options(**options).load(folder)


@pytest.mark.parametrize("hydrogens", [False, True])
def test_tables_equal_those_of_the_scan(spark, folder, hydrogens):
    texts = structures.read_texts(spark, folder + "/{a,b/c}")
    scanned = structures.scan(texts, hydrogens)
    for table in reader.TABLES:
        got = load(spark, folder, table=table, hydrogens=str(hydrogens), partitionBytes="200000")
        want = rows(getattr(scanned, table).select(*got.columns))
        assert len(want) > 20
        assert rows(got) == want


def test_columns_files_and_partitions(spark, folder):
    whole = load(spark, folder)
    assert rows(spark.read.format("structure").schema("aa string, file string").load(folder)) == rows(whole.select("aa", "file"))
    assert load(spark, folder, partitionBytes="1").rdd.getNumPartitions() == 42
    assert whole.rdd.getNumPartitions() == 1
    assert rows(load(spark, folder + "/b")) == rows(whole.where("substring(file, 2)::int % 2 = 0"))
    with pytest.raises(Exception, match="no column weight"):
        spark.read.format("structure").schema("weight double").load(folder).collect()
    with pytest.raises(Exception, match="no table bonds"):
        load(spark, folder, table="bonds").collect()
    with pytest.raises(Exception, match="nowhere"):
        load(spark, folder + "/nowhere").collect()


def test_conditions_on_files_choose_what_is_opened(spark, folder):
    wanted = F.col("file").isin("s3", "s4") & (F.col("aa") != "X")
    want = rows(load(spark, folder).where(wanted))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        asked = load(spark, folder, partitionBytes="1", pushdown="true").where(wanted)
        assert rows(asked) == want and {r[0] for r in want} == {"s3", "s4"}
        assert asked.rdd.getNumPartitions() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_written_files_are_read_back(spark, tmp_path):
    reader.register(spark)
    texts = spark.createDataFrame([(f"x{k}", atom(1, "CA", "LYS", "A", 1, k, 0, 0), k) for k in range(5)] + [("none", None, 9)], "file string, text string, extra int")
    for folder in (str(tmp_path / "plain"), f"file://{tmp_path}/uri"):
        assert reader.write_files(texts, folder) == 6
        assert reader.write_files(texts, folder) == 6
        assert [(r[0], r[6]) for r in rows(load(spark, folder))] == [(f"x{k}", float(k)) for k in range(5)]
    assert all(re.fullmatch(r"(x\d|none)\.pdb\.gz", f.name) for f in (tmp_path / "plain").iterdir())
    assert reader.write_files(texts.limit(0), str(tmp_path / "empty")) == 0
    assert load(spark, str(tmp_path / "empty")).count() == 0
