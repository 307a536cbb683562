"""A whole run by a configuration: from a list of structures to alignments, scores, divergences, trees and written outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.config import Config
from braidwork.functions import scores
from braidwork.operators import chains as ch
from braidwork.operators import gaps, graphs, msa, refinement, sequences, trees
from braidwork.operators.refinement import ELEMENTS
from braidwork.session import stored
from braidwork.sources import lists, sinks, structures

#: Letters of residue types; a type is the place of its letter.
TYPES = "ACDEFGHIKLMNPQRSTVWYX"


def structure_files(spark: SparkSession, config: Config) -> DataFrame:
    """(path, dir) of the files in both folders."""
    found = None
    for k, folder in enumerate((config.pdbdir, config.pdbdir2), 1):
        if folder:
            paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.lit(k).alias("dir"))
            found = paths if found is None else found.unionByName(paths)
    if found is None:
        raise ValueError("no folder of structures is named")
    return found


def read_chains(spark: SparkSession, config: Config) -> DataFrame:
    """(chain, family, name, residues) of each entry of the structure list that has a file with its chain: the chain
    asked for, or the first one, cut to the fragments of its domain. All entries are one family; chain is the entry's
    line, so rows of one list only."""
    entries = lists.parse_list(lists.read_lines(spark, config.pdblist)).withColumn("entry_id", F.col("no").cast("long"))
    paths = stored(lists.resolve_files(entries, structure_files(spark, config), config.pdbext).where("path IS NOT NULL"), "entries")
    folders = [f for f in (config.pdbdir, config.pdbdir2) if f]
    texts = spark.read.option("recursiveFileLookup", "true").text(folders, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    wanted = paths.select(F.regexp_replace("path", "^file:/+", "/").alias("at")).distinct()
    texts = texts.withColumn("at", F.regexp_replace("path", "^file:/+", "/")).join(wanted, "at").select(F.col("at").alias("file"), "text")
    residues = structures.secondary_structure(structures.scan(texts))
    asked = paths.select("entry_id", "domname", F.regexp_replace("path", "^file:/+", "/").alias("file"), F.col("chain").alias("asked"), "frags")
    met = residues.join(asked, "file").where(F.when(F.trim("asked") == "", F.col("chain_num") == 1).otherwise(F.col("chain") == F.col("asked")))
    met = met.where(F.col("frags").isNull() | scores.in_fragments(F.col("res_idx") + 1, F.col("frags")))
    kind = F.greatest(F.instr(F.lit(TYPES), F.col("aa")) - 1, F.lit(0))
    element = F.greatest(F.instr(F.lit(ELEMENTS), F.col("ss")) - 1, F.lit(0)).cast("int")
    own = met.groupBy("entry_id", "domname").agg(F.array_sort(F.collect_list(F.struct("res_idx", "x", "y", "z", kind.cast("int").alias("aa"), element.alias("ss")))).alias("r"))
    return own.select(F.col("entry_id").alias("chain"), F.lit(0).alias("family"), F.col("domname").alias("name"), F.transform("r", lambda s: F.struct(s["x"], s["y"], s["z"], s["aa"], s["ss"])).alias("residues"))


def representatives(chains: DataFrame, config: Config) -> DataFrame:
    """(chain, leader) by the greedy rule on the identity of aligned sequences."""
    return sequences.aligned_leaders(chains, config.seq_thr)


def conformations(chains: DataFrame, lead: DataFrame, config: Config) -> DataFrame:
    """(chain, name, seq, conformation, medoid, central): the chains of one leader, seq, split in order where none of the
    earlier ones is above the structure threshold. A conformation is named by its first chain; medoid and central are the
    chains most similar to the others of the conformation and of the sequence."""
    members = stored(chains.drop("family").join(lead.select("chain", F.col("leader").alias("family")), "chain"), "members")
    pairs = stored(refinement.refined(members, best_only=True).select(F.col("family").cast("long").alias("family"), "i", "j", "tm"), "conformers")
    found = stored(graphs.first_fit(members.select(F.col("chain").alias("node")), pairs.where(F.col("tm") > config.str_thr).select("i", "j")), "conformations")
    split = members.join(found, members.chain == found.node).select("chain", "name", F.col("family").alias("seq"), F.col("root").alias("conformation"))
    of = [found.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ij"]
    inside = pairs.join(of[0], "i").join(of[1], "j").where("i_root = j_root").select(F.col("i_root").alias("family"), "i", "j", "tm")
    for name, key, scored in (("medoid", "conformation", inside), ("central", "seq", pairs)):
        best = ch.medoids(scored, "tm").select(F.col("family").alias(key), F.col("medoid").alias(name))
        split = split.join(best, key, "left").withColumn(name, F.coalesce(name, key))
    return split.select("chain", "name", "seq", "conformation", "medoid", "central")


def with_divergences(both: DataFrame, config: Config) -> DataFrame:
    length, tm = F.col("len").cast("double"), F.coalesce("tm", F.lit(-1.0))
    both = both.withColumn("pc", scores.combined_score(F.col("n_ali"), F.col("si"), tm, F.col("co")))
    return both.withColumns({
        "si_div": scores.divergence(F.col("si"), config.s0, config.d_max), "tm_div": scores.divergence(tm, config.tm0, config.d_max),
        "co_div": scores.contact_divergence(F.col("co"), length), "pc_div": scores.combined_divergence(F.col("pc"), F.col("n_ali"), length),
    })


def score_pairs(chains: DataFrame, config: Config) -> DataFrame:
    """All scores and divergences of pairs that are aligned by position."""
    edges = stored(ch.contacts(ch.residue_rows(chains), config.contact_cutoff, config.contact_separation), "edges")
    return with_divergences(ch.all_scores(chains, edges, config.norm), config)


def aligned(kept: DataFrame, config: Config) -> tuple[DataFrame, msa.Best]:
    """Scores of every refined alignment of the pairs, by type, and the best multiple alignment that is built from them."""
    pairs = stored(refinement.refined(kept, rounds=config.rounds), "refined")
    order = F.array_position(F.array(*[F.lit(t) for t in refinement.TYPES]), F.col("type"))
    columns = ["len", "type", "n_ali", "si", "tm", "co", "pc", "partner"]
    start = pairs.groupBy("family", "i", "j").agg(F.max_by(F.struct(*columns), F.struct(F.round("pc", 9), -order)).alias("s")).select("family", "i", "j", "s.*")
    return pairs, msa.best_alignments(kept, stored(start, "start"), config.msa_rounds, cliques=config.clique)


def summary(pairs: DataFrame, best: msa.Best) -> DataFrame:
    """(what, type, mean) of each score for every type of pair alignment and for the best multiple one."""
    kinds = ["n_ali", "si", "tm", "co", "pc"]
    both = pairs.select("type", *kinds).unionByName(best.pairs.select(F.lit("MSA").alias("type"), *kinds))
    return both.groupBy("type").agg(*[F.avg(k).alias(k) for k in kinds]).unpivot("type", kinds, "what", "mean")


_OUTGROUP = {"TN": "si_div", "CD": "co_div", "TM": "tm_div", "PC": "pc_div"}


def run(spark: SparkSession, config: Config, folder: str) -> dict[str, DataFrame]:
    """Tables of lines by the name of the output, each written to folder/name.output; which ones is for config to say."""
    chains = stored(read_chains(spark, config), "chains")
    if len(chains.take(2)) < 2:
        raise ValueError("fewer than two chains were read")
    lead = stored(representatives(chains, config), "lead")
    split = stored(conformations(chains, lead, config), "split")
    kept = stored(chains.join(split.where("chain = central").select("chain"), "chain"), "representatives")
    if len(kept.take(2)) < 2:
        raise ValueError("all chains have one sequence")
    named = kept.select("chain", "name")
    names = named.withColumnRenamed("chain", "id")
    out = {"nr.pdblist": sinks.structure_list(kept.select(F.substring("name", 1, 4).alias("code"), F.lit("-").alias("chain"), F.col("name").alias("domname")))}
    listed = split.where("chain = medoid").select(F.substring("name", 1, 4).alias("code"), F.lit("-").alias("chain"), F.col("name").alias("domname"), "seq")
    listed = stored(sinks.conformation_list(listed), "conformations")
    if not listed.isEmpty():
        out["nrconf.pdblist"] = listed
    letters = F.array_join(F.transform("residues", lambda r: F.substring(F.lit(TYPES), r["aa"] + 1, F.lit(1))), "")
    if config.print_fasta or config.exit_fasta:
        out["input.fasta"] = sinks.fasta(chains.select("name", letters.alias("seq")), "name", "seq")
    if not config.exit_fasta:
        refined, best = aligned(kept, config)
        pairs = stored(with_divergences(msa.aligned_scores(best.state, config.norm, config.contact_cutoff, config.contact_separation), config), "pairs")
        d = pairs.select("family", "i", "j", F.col(_OUTGROUP[config.outgroup]).alias("d"))
        out["PCAli.fas"] = sinks.fasta(msa.alignment_rows(best.state, TYPES).join(named, "chain"), "name", "row")
        out["PCAli.ss.msa"] = sinks.fasta(msa.element_rows(best.state).join(named, "chain"), "name", "row")
        if config.ali_ss:
            rows, _ = gaps.out_of_elements(msa.with_element_lists(best.state), config.shift_max)
            shifted = best.state.drop("places").join(rows.select("family", "chain", "places"), ["family", "chain"])
            out["SSAli.msa"] = sinks.fasta(msa.alignment_rows(shifted, TYPES).join(named, "chain"), "name", "row")
        out["summary"] = sinks.summary_lines(summary(refined, best))
        found = stored(trees.family_trees(d), "trees")
        out["nj.tree"] = sinks.tree_lines(found, names)
        members = split.groupBy(F.col("central").alias("id")).agg(F.array_sort(F.collect_list("name")).alias("m"))
        out["nj.seqtree"] = sinks.tree_lines(found, members.select("id", sinks.grafted(F.col("m")).alias("name")))
        every = best.rounds.select(F.col("round").alias("family"), "i", "j", "d")
        out["round.tree"] = sinks.tree_lines(trees.family_trees(every), names)
        if config.print_pdb:
            out["models.pdb"] = msa.models(best.state).select(F.col("text").alias("line"))
        if config.print_sim:
            out["prot.sim"] = sinks.similarity_table(pairs)
        if config.print_div:
            out["prot.div"] = sinks.divergence_table(pairs)
            out["PC.div"] = sinks.matrix_lines(pairs.select("i", "j", F.col("pc_div").alias("d")), named)
        if config.print_cv:
            found = trees.related_outgroups(trees.outgroups(d), pairs, config.si_thr)
            cv = trees.clock_violations(found, pairs.select("family", "i", "j", "si"))
            out["cv"] = sinks.clock_table(cv.join(trees.distant_pairs(pairs, config.si_thr).select("i", "j"), ["i", "j"], "left_semi"))
    for name, lines in out.items():
        sinks.write_lines(lines, f"{folder.rstrip('/')}/{config.name}.{name}")
    return out
