"""Written outputs, as (name, text) or line tables; write_lines puts them to a folder with Spark's own writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = 60


def fasta(rows: DataFrame, name: str, seq: str) -> DataFrame:
    """(line): FASTA records of a table."""
    return rows.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.regexp_replace(seq, f"(.{{{LINE}}})(?=.)", "$1\n")).alias("line"))


def structure_list(clusters: DataFrame) -> DataFrame:
    """(line): code, chain, domain (if clusters has it; all or none), domain name and folder (1 if it has none) of each
    representative. clusters: (code, chain, domname). A reader takes the third column for a domain if it holds a minus."""
    domain = [F.coalesce("domain", F.lit("-"))] if "domain" in clusters.columns else [F.lit("-")]
    folder = F.coalesce(F.col("dir"), F.lit(1)) if "dir" in clusters.columns else F.lit(1)
    return clusters.select(F.concat_ws(" ", "code", "chain", *domain, "domname", folder.cast("string")).alias("line"))


def conformation_list(conformations: DataFrame) -> DataFrame:
    """(line): code, chain and domain name of each conformation, with the number of its sequence; none if no sequence has
    several. conformations: (code, chain, domname, seq)."""
    several = conformations.agg((F.count(F.lit(1)) > F.countDistinct("seq")).alias("several"))  # one row
    return conformations.crossJoin(F.broadcast(several)).where("several").select(F.concat_ws(" ", "code", "chain", "domname", F.col("seq").cast("string")).alias("line"))


def aligned_fasta(msa: DataFrame) -> DataFrame:
    """(name, row text) of a long alignment. msa: (name, col, aa); a row that lacks a column has a gap there."""
    width = msa.groupBy().agg((F.max("col") + 1).alias("width"))  # one row
    cells = msa.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("col", "aa"))).alias("cells"))
    row = F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.coalesce(F.element_at("cells", k), F.lit("-"))), "")
    return cells.crossJoin(width).select("name", row.alias("seq"))


def square_matrix(d: DataFrame, names: list[int]) -> DataFrame:
    """(line): N, then a row of distances for each name; for tables small enough to be read as text."""
    both = d.select("i", "j", "d").unionByName(d.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    wide = both.groupBy("i").pivot("j", names).agg(F.first("d"))
    cells = [F.format_string("%.4f", F.coalesce(F.col(f"`{n}`"), F.lit(0.0))) for n in names]
    body = wide.select(F.col("i").alias("no"), F.concat_ws(" ", F.col("i").cast("string"), *cells).alias("line"))
    head = d.sparkSession.createDataFrame([(-1, str(len(names)))], "no long, line string")
    return head.unionByName(body).orderBy("no").select("line")


def matrix_lines(d: DataFrame, names: DataFrame) -> DataFrame:
    """(line): the number of chains, then for each chain, in order, its name and its distances to all. d: (i, j, d), one
    row a pair; names: (chain, name). Missing pairs have distance 0."""
    both = d.select("i", "j", "d").unionByName(d.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    cells = both.unionByName(names.select(F.col("chain").alias("i"), F.col("chain").alias("j"), F.lit(0.0).alias("d")))
    rows = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "d"))).alias("cells")).join(names.select(F.col("chain").alias("i"), "name"), "i")
    body = rows.select(F.col("i").alias("no"), F.concat_ws(" ", "name", F.array_join(F.transform("cells", lambda c: F.format_string("%.4f", c["d"])), " ")).alias("line"))
    head = names.agg(F.count(F.lit(1)).cast("string").alias("line")).select(F.lit(-1).cast("long").alias("no"), "line")
    return head.unionByName(body).orderBy("no").select("line")


def grafted(members: Column) -> Column:
    """The text of a leaf that stands for several members, all at distance 0 from it."""
    return F.when(F.size(members) == 1, members[0]).otherwise(F.concat(F.lit("("), F.array_join(F.transform(members, lambda m: F.concat(m, F.lit(":0"))), ","), F.lit(")")))


def similarity_table(scores: DataFrame) -> DataFrame:
    """(line): tab-separated pair scores in the order aligned fraction, identity, contact overlap, superposition, combined."""
    values = [F.format_string("%.4f", F.col(c)) for c in ("n_ali", "si", "co", "tm", "pc")]
    return scores.select(F.concat_ws("\t", F.col("i").cast("string"), F.col("j").cast("string"), *values).alias("line"))


def divergence_table(div: DataFrame) -> DataFrame:
    values = [F.format_string("%.4f", F.col(c)) for c in ("si_div", "tm_div", "co_div", "pc_div")]
    return div.select(F.concat_ws("\t", F.col("i").cast("string"), F.col("j").cast("string"), *values).alias("line"))


def clock_table(cv: DataFrame) -> DataFrame:
    return cv.select(F.format_string("%d\t%d\t%d\t%.4f\t%.3f\t%d\t%d", "i", "j", "n_out", "cv", "t", "n_tiv", "n_sign").alias("line"))


def summary_lines(means: DataFrame) -> DataFrame:
    """(line): one line a score with its mean for each alignment type. means: (what, type, mean)."""
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "mean"))), lambda s: F.format_string("%s: %.4f", s["type"], s["mean"])), " ")
    return means.groupBy("what").agg(F.concat(F.lit("Mean "), F.first("what"), F.lit(" "), cells).alias("line")).select("line")


def models(residues: DataFrame) -> DataFrame:
    """(model, text): superposed chains as numbered models. residues: (model, res, code, x, y, z)."""
    line: Column = F.format_string("ATOM  %5d  CA  %3s A%4d    %8.3f%8.3f%8.3f  1.00  0.00           C  ", F.col("res") + 1, F.col("code"), F.col("res") + 1, "x", "y", "z")
    body = residues.withColumn("line", line).groupBy("model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("res", "line"))), lambda s: s["line"]), "\n").alias("body"))
    return body.select("model", F.concat(F.format_string("MODEL     %4d\n", F.col("model")), F.col("body"), F.lit("\nENDMDL\n")).alias("text"))


def element_fasta(msa: DataFrame, name: str = "name") -> DataFrame:
    """(name, seq): rows of secondary structure of an alignment, H, E, blank for neither, minus for gaps. msa: (name, col, ss)."""
    return aligned_fasta(msa.select(F.col(name).alias("name"), "col", F.when(F.col("ss").isin("H", "E"), F.col("ss")).otherwise(F.lit(" ")).alias("aa")))


def propensity_lines(propensities: DataFrame) -> DataFrame:
    """(line): bin, both states, how often they are paired and the propensity. propensities: (bin, a, b, n, propensity)."""
    return propensities.select(F.concat_ws("\t", F.col("bin").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"), F.col("n").cast("string"), F.format_string("%.4f", "propensity")).alias("line"))


def ratio_lines(ratios: DataFrame) -> DataFrame:
    """(line): class, name, value and error of each ratio, NA where it has no value. ratios: (class, what, value, se)."""
    value, se = (F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.4f", c)), F.lit("NA")) for c in ("value", "se"))
    return ratios.select(F.concat_ws("\t", "class", "what", value, se).alias("line"))


def rate_lines(rates: DataFrame, name: str = "bin") -> DataFrame:
    """(line): bin, cases, hits, frequency and error. rates: (bin, n, hits, p, se)."""
    return rates.select(F.format_string("%s\t%d\t%d\t%.4f\t%.4f", F.col(name).cast("string"), "n", "hits", "p", "se").alias("line"))


def distance_lines(scaled: DataFrame) -> DataFrame:
    """(line): bin, exponent, pairs, mean and error of scaled clock violations, and how many are significant."""
    return scaled.select(F.format_string("%s\t%.2f\t%d\t%.4f\t%.4f\t%d", F.col("bin").cast("string"), "exponent", "n", "mean", "se", "significant").alias("line"))


def tree_lines(trees: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(line): the tree of each family, with the leaves' numbers replaced by names. trees: (family, newick); names: (id, name)."""
    if names is None:
        return trees.select(F.col("newick").alias("line"))
    parts = trees.select("family", F.posexplode(F.split("newick", r"(?<=[(,])(?=[0-9])|(?<=[0-9])(?=:)")).alias("at", "part"))
    known = parts.join(names.select(F.col("id").cast("string").alias("part"), "name"), "part", "left")
    return known.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("name", "part").alias("text")))), lambda s: s["text"]), "").alias("line")).select("line")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.text(path)
