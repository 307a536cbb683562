"""Line-based inputs: structure lists, FASTA and aligned FASTA, function similarities, parameter and matrix files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwork.functions.scores import domain_fragments

#: Columns of a written sequence line.
LINE = 60


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, no, line) of text files; a file's lines are numbered in order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return whole.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("no", "line"))


def _columns(lines: DataFrame) -> DataFrame:
    kept = lines.where(~F.ltrim("line").startswith("#") & (F.trim("line") != ""))
    return kept.withColumn("c", F.split(F.trim("line"), r"\s+"))


def parse_list(lines: DataFrame) -> DataFrame:
    """lines: (file, no, line). (file, no, code, chain, domain, frags, domname, dir) of a structure list.

    The third column is a domain if that of the file's first three-column row holds a minus, else a folder number;
    the domain's name is code and chain unless given."""
    rows = _columns(lines).withColumn("third", F.get("c", F.lit(2)))
    kinds = rows.where("third IS NOT NULL").groupBy("file").agg(F.min_by(F.contains("third", F.lit("-")), "no").alias("is_domain"))
    both = rows.join(kinds, "file", "left").withColumn("is_domain", F.coalesce("is_domain", F.lit(True)))
    domain = F.when(F.col("is_domain"), F.col("third"))
    folder = F.when(F.col("is_domain"), F.get("c", F.lit(4))).otherwise(F.col("third"))
    folder = F.coalesce(folder.cast("int"), F.lit(1))
    checked = F.when(folder.isin(1, 2), folder).otherwise(F.raise_error(F.concat(F.lit("folder must be 1 or 2: "), F.col("line"))).cast("int"))
    chain = F.coalesce(F.get("c", F.lit(1)), F.lit(" "))
    return both.select("file", "no", F.get("c", F.lit(0)).alias("code"), chain.alias("chain"), domain.alias("domain"), domain_fragments(domain).alias("frags"), F.coalesce(F.get("c", F.lit(3)), F.concat(F.get("c", F.lit(0)), F.trim(chain))).alias("domname"), checked.alias("dir"))


def fasta_texts(rows: DataFrame) -> DataFrame:
    """rows: (name, seq). (file, text): one FASTA record a row."""
    wrapped = F.regexp_replace("seq", f"(.{{{LINE}}})(?=.)", "$1\n")
    return rows.select(F.col("name").alias("file"), F.concat(F.lit(">"), F.col("name"), F.lit("\n"), wrapped, F.lit("\n")).alias("text"))


def parse_fasta(texts: DataFrame, aligned: bool = False) -> DataFrame:
    """texts: (file, text). (file, row, name, code, chain, domain, dir, seq) of each record.

    A header is a name and optionally chain, domain and folder; without them the chain is the fifth character of the
    name, or the sixth after an underscore. With aligned, rows are filled with gaps to the file's longest."""
    return parse_records(texts.select("file", F.posexplode(F.split(F.regexp_replace("text", r"(?m)^#.*$", ""), r"(?m)^>")).alias("row", "body")).where("row > 0"), aligned)


def read_fasta(spark: SparkSession, path: str, aligned: bool = False) -> DataFrame:
    """The records of FASTA files as parse_fasta gives them, read record by record, so that large files are split among
    tasks. row tells the records of a file apart; it rises within a split, but not from split to split."""
    found = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"), F.regexp_replace("value", "^>", "").alias("body"))
    # what stands before the first record of a file, such as comments, is none
    return parse_records(found.where(~F.ltrim("body").startswith("#") & (F.trim("body") != "")), aligned)


def parse_records(records: DataFrame, aligned: bool = False) -> DataFrame:
    """records: (file, row, body), the body being a header line and lines of sequence."""
    head = F.split(F.trim(F.substring_index("body", "\n", 1)), r"\s+")
    body = F.regexp_replace(F.regexp_replace("body", r"^[^\n]*\n?", ""), r"(?m)^#.*$", "")
    rows = records.withColumn("h", head).withColumn("seq", F.regexp_replace(body, r"\s", ""))
    name = F.get("h", F.lit(0))
    stem = F.regexp_replace(name, r"\.[A-Za-z]+$", "")
    implied = F.when(F.substring(stem, 5, 1) == "_", F.substring(stem, 6, 1)).otherwise(F.substring(stem, 5, 1))
    out = rows.select("file", "row", name.alias("name"), F.substring(name, 1, 4).alias("code"), F.coalesce(F.get("h", F.lit(1)), F.when(implied != "", implied), F.lit(" ")).alias("chain"), F.get("h", F.lit(2)).alias("domain"), F.coalesce(F.get("h", F.lit(3)).cast("int"), F.lit(1)).alias("dir"), "seq")
    if not aligned:
        return out
    longest = out.groupBy("file").agg(F.max(F.length("seq")).cast("int").alias("n"))
    return out.join(longest, "file").withColumn("seq", F.rpad("seq", F.col("n"), F.lit("-"))).drop("n").select(*out.columns)


def msa_rows(aligned: DataFrame) -> DataFrame:
    """(file, row, col, res, aa): residues of an aligned FASTA, without gaps; columns and residues count from 0.
    Columns in which every row has a gap are left out of the numbering."""
    cells = aligned.select("file", "row", F.posexplode(F.split("seq", "")).alias("raw", "aa")).where((F.col("aa") != "-") & (F.col("aa") != ""))
    used = cells.select("file", "raw").distinct().withColumn("col", F.row_number().over(Window.partitionBy("file").orderBy("raw")) - 1)
    res = F.row_number().over(Window.partitionBy("file", "row").orderBy("raw")) - 1
    return cells.withColumn("res", res).join(used, ["file", "raw"]).select("file", "row", "col", "res", "aa")


def parse_similarities(lines: DataFrame) -> DataFrame:
    """(name1, name2, sim) of a function similarity file."""
    return _columns(lines).where(F.size("c") >= 3).select("no", F.get("c", F.lit(0)).alias("name1"), F.get("c", F.lit(1)).alias("name2"), F.get("c", F.lit(2)).cast("double").alias("sim"))


def similarity_of(names: DataFrame, similarities: DataFrame) -> DataFrame:
    """names: (id, name). (i, j, sim), both orders: names match on their first five characters, the first row of
    equal matches wins; pairs that are not listed are absent."""
    key = names.select("id", F.substring("name", 1, 5).alias("k")).groupBy("k").agg(F.min("id").alias("id"))
    a, b = key.select(F.col("k").alias("k1"), F.col("id").alias("i")), key.select(F.col("k").alias("k2"), F.col("id").alias("j"))
    met = similarities.withColumn("k1", F.substring("name1", 1, 5)).withColumn("k2", F.substring("name2", 1, 5)).join(a, "k1").join(b, "k2")
    one = met.groupBy("i", "j").agg(F.min_by("sim", "no").alias("sim"))
    return one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "sim")).dropDuplicates(["i", "j"])


def parse_matrix(lines: DataFrame) -> DataFrame:
    """(a, b, s) of a substitution matrix: a header row of residues, then a row of scores for each of them."""
    rows = lines.where(~F.ltrim("line").startswith("!") & ~F.ltrim("line").startswith("#") & (F.trim("line") != "")).withColumn("c", F.split(F.trim("line"), r"\s+"))
    heads = rows.groupBy("file").agg(F.min_by("c", "no").alias("head"), F.min("no").alias("first"))
    body = rows.join(heads, "file").where("no > first").withColumn("a", F.get("c", F.lit(0)))
    return body.select("file", "a", F.explode(F.arrays_zip(F.col("head").alias("b"), F.slice("c", F.lit(2), F.size("head")).alias("s"))).alias("z")).select("file", "a", F.col("z.b").alias("b"), F.col("z.s").cast("double").alias("s"))


def parse_parameters(lines: DataFrame) -> DataFrame:
    """(key, value) of KEY=value lines; of equal keys the last wins."""
    kept = lines.where(~F.ltrim("line").startswith("#") & F.contains("line", F.lit("=")))
    pairs = kept.select("no", F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(F.regexp_replace("line", "^[^=]*=", "")).alias("value"))
    return pairs.groupBy("key").agg(F.max_by("value", "no").alias("value"))


def resolve_files(entries: DataFrame, files: DataFrame, extension: str = ".pdb") -> DataFrame:
    """entries: (entry_id, code, dir) and, if known, domname; files: (path) and, if there are two folders, dir. entries
    with the path of the first of: code and extension (also compressed), code alone, the first four characters where the
    fifth is an underscore, the domain's name and extension; each in the entry's own folder, then all in the other one.
    Null where none exists."""
    folder = F.col("dir") if "dir" in files.columns else F.lit(1)
    known = files.select("path", folder.alias("at"), F.regexp_extract("path", r"([^/]*)$", 1).alias("base"))
    own = F.col("dir") if "dir" in entries.columns else F.lit(1)
    last = [F.concat("domname", F.lit(extension))] if "domname" in entries.columns else []
    short = F.when(F.substring("code", 5, 1) == "_", F.concat(F.substring("code", 1, 4), F.lit(extension)))
    names = F.filter(F.array(F.concat("code", F.lit(extension)), F.concat("code", F.lit(extension + ".gz")), F.col("code"), short, *last), lambda c: c.isNotNull())
    tried = entries.select("entry_id", own.alias("own"), F.posexplode(names).alias("order", "base"))
    rank = F.struct((F.col("at") != F.col("own")).alias("other"), "order", "path")
    best = tried.join(known, "base").groupBy("entry_id").agg(F.min(rank).alias("b")).select("entry_id", "b.path")
    return entries.join(best, "entry_id", "left")
