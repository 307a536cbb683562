"""Fixed-width structure files: a scan of whole files into typed tables, and a writer.

A scan returns six DataFrames. Each keeps a file's records apart by its path, so files are read in parallel and no
step looks beyond one file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Residue names and their letters.
LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
NUCLEOTIDES = ("A", "C", "G", "U", "I", "T", "DA", "DC", "DG", "DT", "DI", "DU")
OLIGOMERS = ("MONOMERIC", "DIMERIC", "TRIMERIC", "TETRAMERIC", "PENTAMERIC", "HEXAMERIC", "HEPTAMERIC", "OCTAMERIC", "NONAMERIC", "DECAMERIC")
ONE_LETTER = "ARNDCQEG"


@dataclass
class Scan:
    """files: (file, method, oligomer); atoms: (file, chain, chain_num, res_idx, label, aa, atom, x, y, z);
    residues: (file, chain, res_idx, label, aa, x, y, z, seqres); elements: (file, chain, type, ini, end); missing: (file,
    chain, label, aa, no), residues that the file says to have no atoms."""

    files: DataFrame
    atoms: DataFrame
    residues: DataFrame
    elements: DataFrame
    seqres: DataFrame
    missing: DataFrame


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of every file under path; compressed files are read as such by their suffix."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return whole.select(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(\.(pdb|ent|txt))?(\.gz)?$", "").alias("file"), "text")


def _cut(start: int, size: int) -> Column:
    """Columns of a record, counted from 0."""
    return F.substring("line", start + 1, size)


def scan(texts: DataFrame, hydrogens: bool = False) -> Scan:
    """texts: (file, text). Rules: first model only; a chain ends at TER; hydrogens are dropped; of alternate
    locations the first one seen stays; a residue begins where the label changes; a hetero residue counts only if it
    has the atoms N and CA; an insertion alternate less than 1 from the first atom of the residue before is dropped;
    modified residues take the letter that MODRES gives them, first entry first."""
    lines = texts.select("file", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    stop = lines.where(F.col("line").startswith("ENDMDL")).groupBy("file").agg(F.min("no").alias("stop"))
    lines = lines.join(stop, "file", "left").where(F.col("stop").isNull() | (F.col("no") < F.col("stop"))).drop("stop")

    by_file = Window.partitionBy("file").orderBy("no")
    record = F.col("line").startswith("ATOM") | F.col("line").startswith("HETATM")
    ter = F.col("line").startswith("TER")
    body = lines.where(record | ter).withColumn("chain", F.when(record, _cut(21, 1)))
    closed = F.last(F.when(ter, F.col("no")), True).over(by_file)
    body = body.withColumn("ter", closed)
    fixed = [F.expr(f"try_cast(trim(substring(line, {31 + 8 * k}, 8)) AS double)") for k in range(3)]
    atoms = body.where(record).select(
        "file", "no", "chain", F.col("line").startswith("HETATM").alias("hetero"), "ter",
        F.trim(_cut(12, 4)).alias("atom"), F.trim(_cut(16, 1)).alias("alt"), F.trim(_cut(17, 3)).alias("code"), F.trim(_cut(22, 5)).alias("label"),
        F.substring("line", 14, 1).alias("element"), *[c.alias(n) for c, n in zip(fixed, "xyz", strict=True)],
    )
    if not hydrogens:
        atoms = atoms.where(F.col("element") != "H")
    # records of a chain after its TER are ligands and water
    own_start = F.min("no").over(Window.partitionBy("file", "chain"))
    atoms = atoms.withColumn("own_start", own_start).where(F.col("ter").isNull() | (F.col("ter") < F.col("own_start")))
    kept_alt = F.first(F.when(F.col("alt") != "", F.col("alt")), True).over(Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    atoms = atoms.withColumn("kept_alt", kept_alt).where((F.col("alt") == "") | (F.col("alt") == F.col("kept_alt")))

    by_chain = Window.partitionBy("file", "chain").orderBy("no")
    fresh = F.coalesce((F.lag("label").over(by_chain) != F.col("label")).cast("int"), F.lit(1))
    atoms = atoms.withColumn("raw", F.sum(fresh).over(by_chain))
    by_residue = Window.partitionBy("file", "chain", "raw")
    names = F.collect_set("atom").over(by_residue)
    atoms = atoms.withColumn("names", names).where(~F.col("hetero") | (F.array_contains("names", "N") & F.array_contains("names", "CA")))
    firsts = atoms.groupBy("file", "chain", "raw").agg(F.min_by(F.struct("label", "code", "x", "y", "z"), "no").alias("f"))
    before = F.lag("f").over(Window.partitionBy("file", "chain").orderBy("raw"))
    far = (F.col("f.x") - before["x"]) ** 2 + (F.col("f.y") - before["y"]) ** 2 + (F.col("f.z") - before["z"]) ** 2
    inserted = F.col("f.label").rlike("[A-Za-z]$") & (far < 1.0)
    firsts = firsts.withColumn("dropped", F.coalesce(inserted, F.lit(False))).where(~F.col("dropped"))
    placed = firsts.withColumn("res_idx", F.row_number().over(Window.partitionBy("file", "chain").orderBy("raw")) - 1)

    modified = lines.where(F.col("line").startswith("MODRES")).groupBy("file", F.trim(_cut(12, 3)).alias("code")).agg(F.min_by(F.trim(_cut(24, 3)), "no").alias("standard"))
    letters = F.create_map(*[F.lit(v) for pair in LETTERS.items() for v in pair])
    placed = placed.withColumn("code", F.col("f.code")).join(modified, ["file", "code"], "left")
    aa = F.coalesce(F.element_at(letters, F.col("code")), F.element_at(letters, F.col("standard")), F.lit("X"))
    placed = placed.withColumn("aa", aa).withColumn("nucleic", F.col("code").isin(*NUCLEOTIDES))

    starts = atoms.groupBy("file", "chain").agg(F.min("no").alias("start"))
    starts = starts.withColumn("chain_num", F.row_number().over(Window.partitionBy("file").orderBy("start"))).drop("start")
    protein = placed.where(~F.col("nucleic")).select("file", "chain", "raw", "res_idx", "aa").join(starts, ["file", "chain"])
    out = atoms.join(protein, ["file", "chain", "raw"]).select("file", "chain", "chain_num", "res_idx", "label", "aa", "no", "atom", "x", "y", "z")
    alpha = F.min_by(F.struct("x", "y", "z"), F.when(F.col("atom") == "CA", F.col("no")))
    residues = out.groupBy("file", "chain", "chain_num", "res_idx", "label", "aa").agg(F.coalesce(alpha, F.min_by(F.struct("x", "y", "z"), "no")).alias("p"))
    residues = residues.select("file", "chain", "chain_num", "res_idx", "label", "aa", "p.x", "p.y", "p.z")

    helix = lines.where(F.col("line").startswith("HELIX")).select("file", _cut(19, 1).alias("chain"), F.lit("H").alias("type"), F.trim(_cut(21, 5)).alias("ini"), F.trim(_cut(33, 5)).alias("end"), "no")
    sheet = lines.where(F.col("line").startswith("SHEET")).select("file", _cut(21, 1).alias("chain"), F.lit("E").alias("type"), F.trim(_cut(22, 5)).alias("ini"), F.trim(_cut(33, 5)).alias("end"), "no")
    codes = lines.where(F.col("line").startswith("SEQRES")).select("file", _cut(11, 1).alias("chain"), "no", F.posexplode(F.filter(F.split(F.substring("line", 20, 52), r"\s+"), lambda c: c != "")).alias("k", "code"))
    order = Window.partitionBy("file", "chain").orderBy("no", "k")
    seqres = codes.join(modified, ["file", "code"], "left").select("file", "chain", (F.row_number().over(order)).alias("pos"), F.coalesce(F.element_at(letters, F.col("code")), F.element_at(letters, F.col("standard")), F.lit("X")).alias("aa"))

    # REMARK 465 lists residue name, chain and label, in its own columns
    gone = lines.where(F.col("line").rlike(r"^REMARK 465 +([0-9]+ +)?[A-Z0-9]{1,3} +[^ ] +-?[0-9]+[A-Z]? *$")).withColumn("w", F.split(F.trim(F.substring("line", 11, 70)), r"\s+"))
    missing = gone.select("file", F.element_at("w", -2).alias("chain"), F.element_at("w", -1).alias("label"), F.element_at("w", -3).alias("code"), "no").join(modified, ["file", "code"], "left")
    missing = missing.select("file", "chain", "label", F.coalesce(F.element_at(letters, F.col("code")), F.element_at(letters, F.col("standard")), F.lit("X")).alias("aa"), "no")

    method = F.when(F.col("line").contains("NMR"), "N").when(F.col("line").contains("ELECTRON"), "E").otherwise("X")
    methods = lines.where(F.col("line").startswith("EXPDTA")).groupBy("file").agg(F.min_by(method, "no").alias("method"))
    word = F.regexp_extract("line", r"\b([A-Z]+MERIC)\b", 1)
    size = F.array_position(F.array(*[F.lit(o) for o in OLIGOMERS]), word)
    oligomers = lines.where(F.col("line").startswith("REMARK 350")).groupBy("file").agg(F.nullif(F.max(size), F.lit(0)).alias("oligomer"))
    files = texts.select("file").join(methods, "file", "left").join(oligomers, "file", "left")
    return Scan(files, out.drop("no"), residues, helix.unionByName(sheet), seqres, missing)


def secondary_structure(scanned: Scan) -> DataFrame:
    """Residues with their element: H, E or blank. Elements cover the residues between their end labels, or to the
    chain's end where the last label is missing; a later element overrides an earlier one."""
    r = scanned.residues
    ini = r.select("file", "chain", F.col("label").alias("ini"), F.col("res_idx").alias("first"))
    end = r.select("file", "chain", F.col("label").alias("end"), F.col("res_idx").alias("last"))
    spans = scanned.elements.join(ini, ["file", "chain", "ini"]).join(end, ["file", "chain", "end"], "left").select("file", "chain", "type", "no", "first", "last")
    met = r.select("file", "chain", "res_idx").join(spans, ["file", "chain"]).where((F.col("res_idx") >= F.col("first")) & (F.col("last").isNull() | (F.col("res_idx") <= F.col("last"))))
    types = met.groupBy("file", "chain", "res_idx").agg(F.max_by("type", "no").alias("ss"))
    return r.join(types, ["file", "chain", "res_idx"], "left").withColumn("ss", F.coalesce("ss", F.lit(" ")))


def seqres_positions(scanned: Scan) -> DataFrame:
    """(file, chain, res_idx, pos): each residue takes the next equal letter of its chain's SEQRES after the one that
    the residue before took; null where none is left."""
    letters = scanned.seqres.groupBy("file", "chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "aa"))), lambda s: s["aa"]), "").alias("seq"))
    rows = scanned.residues.groupBy("file", "chain").agg(F.array_sort(F.collect_list(F.struct("res_idx", "aa"))).alias("own"))
    none = F.array().cast("array<struct<res_idx:int,pos:int>>")

    def step(acc: Column, r: Column) -> Column:
        found = F.call_function("locate", r["aa"], F.col("seq"), acc["at"] + 1)
        return F.struct(F.greatest(found, acc["at"]).alias("at"), F.concat(acc["found"], F.array(F.struct(r["res_idx"].alias("res_idx"), F.nullif(found, F.lit(0)).alias("pos")))).alias("found"))

    walk = F.aggregate("own", F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])
    return rows.join(letters, ["file", "chain"]).select("file", "chain", F.inline(walk))


def whole_sequences(scanned: Scan) -> DataFrame:
    """(file, chain, pos, label, aa, seen) of the chains without SEQRES: residues with atoms and those that are missing,
    in the order of their numbers; of equal numbers, those with atoms first, as they stand."""
    declared = scanned.seqres.select("file", "chain").distinct()
    seen = scanned.residues.select("file", "chain", "label", "aa", F.col("res_idx").alias("no"), F.lit(True).alias("seen"))
    rows = seen.unionByName(scanned.missing.select("file", "chain", "label", "aa", "no", F.lit(False).alias("seen"))).join(declared, ["file", "chain"], "left_anti")
    number = F.regexp_extract("label", r"^-?\d+", 0).cast("int")
    order = Window.partitionBy("file", "chain").orderBy(number.asc_nulls_last(), F.desc("seen"), "no")
    return rows.withColumn("pos", F.row_number().over(order)).select("file", "chain", "pos", "label", "aa", "seen")


def structure_texts(chains: DataFrame) -> DataFrame:
    """chains: (chain, residues). (file, text): each chain as a structure file with one CA atom a residue."""
    names = {v: k for k, v in LETTERS.items()}
    code = F.array(*[F.lit(names[c]) for c in ONE_LETTER])

    def line(r: Column, k: Column) -> Column:
        return F.format_string("ATOM  %5d  CA  %3s A%4d    %8.3f%8.3f%8.3f  1.00  0.00           C  ", k + 1, F.element_at(code, r["aa"] + 1), k + 1, r["x"], r["y"], r["z"])

    return chains.select(F.col("chain").cast("string").alias("file"), F.concat(F.array_join(F.transform("residues", line), "\n"), F.lit("\nTER\nEND\n")).alias("text"))
