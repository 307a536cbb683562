"""Sequences of tokens: identity by position and by alignment, leader clusters, subsequences, identity bins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.operators.kernels import SEARCH_TILE, TERM_WEIGHTS
from braidwork.operators.refinement import CELLS, ELEMENT_SIMILARITY, ELEMENT_WEIGHT, GAP_OPEN_FIRST, affine_partners, self_similarities, similarity_matrix
from braidwork.operators.tiles import Tiles, over_pairs
from braidwork.session import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Tokens of a band. Sequences that differ in fewer than a 20th of the positions agree in a whole band of ten.
BAND, IDENTITY = 10, 0.95


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"))


def distinct_sequences(docs: DataFrame) -> DataFrame:
    """(seq, tokens, copies): one row for each different token sequence, named by its least doc_id."""
    rows = docs.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("tokens")).where(F.size("tokens") > 0)
    keyed = rows.withColumn("key", F.xxhash64("tokens"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("seq"), F.count(F.lit(1)).alias("copies"), F.first("tokens").alias("tokens")).drop("key")


def band_keys(seqs: DataFrame, *columns: str) -> DataFrame:
    """(seq, columns, key, role): hashes by which sequences are met. Bands of BAND tokens meet bands at the same place; a sequence
    without a whole band (role short) meets the starts of its length (role start)."""
    n = F.size("tokens")
    band = F.transform(F.sequence(F.lit(1), F.floor(n / BAND).cast("int")), lambda b: F.xxhash64(F.lit("band"), b, F.slice("tokens", (b - 1) * BAND + 1, BAND)))
    bands = seqs.where(n >= BAND).select("seq", *columns, F.explode(band).alias("key"), F.lit("band").alias("role"))
    starts = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(BAND - 1))), lambda m: F.xxhash64(F.lit("start"), m, F.slice("tokens", F.lit(1), m)))
    prefixes = seqs.select("seq", *columns, F.explode(starts).alias("key"), F.lit("start").alias("role"))
    shorts = seqs.where(n < BAND).select("seq", *columns, F.xxhash64(F.lit("start"), n, F.col("tokens")).alias("key"), F.lit("short").alias("role"))
    return bands.unionByName(prefixes).unionByName(shorts)


def met_by_keys(one: DataFrame, two: DataFrame) -> DataFrame:
    """(i, j), i > j: sequences of one and of two (band_keys) that share a key, each pair once."""
    a, b = one.select(F.col("seq").alias("x"), "key", F.col("role").alias("a_role")), two.select(F.col("seq").alias("y"), "key", F.col("role").alias("b_role"))
    fit = ((F.col("a_role") == "band") & (F.col("b_role") == "band")) | ((F.col("a_role") == "short") & (F.col("b_role") == "start")) | ((F.col("a_role") == "start") & (F.col("b_role") == "short"))
    return a.join(b, "key").where(fit & (F.col("x") != F.col("y"))).select(F.greatest("x", "y").alias("i"), F.least("x", "y").alias("j")).distinct()


def identical_enough(pairs: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """pairs: (i, j). (i, j, same, si) of those with more than threshold of the shorter one's positions equal."""
    a, b = seqs.select(F.col("seq").alias("i"), F.col("tokens").alias("a")), seqs.select(F.col("seq").alias("j"), F.col("tokens").alias("b"))
    same = F.aggregate(F.zip_with("a", "b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    both = pairs.join(a, "i").join(b, "j").select("i", "j", same.alias("same"), F.least(F.size("a"), F.size("b")).alias("m"))
    return both.select("i", "j", "same", (F.col("same") / F.col("m")).alias("si")).where(F.col("si") > threshold)


def check_threshold(threshold: float) -> None:
    if threshold < 1 - 1 / (2 * BAND):
        raise ValueError(f"bands of {BAND} find all pairs only above an identity of {1 - 1 / (2 * BAND)}")


@dataclass
class Sides:
    """Keys by which near sequences are met. wanted and known: (seq, n, key), known of all sequences and wanted of those
    that are the shorter one of a pair; n is a sequence's number of tokens."""

    wanted: DataFrame
    known: DataFrame


def sides(seqs: DataFrame, threshold: float) -> Sides:
    """Where the shorter one of two sequences differs in at most d positions, at most d of its bands differ, so of any
    d + 1 of them one agrees: its d + 1 rarest are wanted. Passages that many texts repeat at one place meet none by that."""
    check_threshold(threshold)
    keys = stored(band_keys(seqs.withColumn("n", F.size("tokens")), "n"), "keys")
    bands, shorts = keys.where("role = 'band'"), keys.where("role = 'short'")
    often = bands.groupBy("key").agg(F.count(F.lit(1)).alias("often"))
    counted = stored(bands.join(often, "key").select("seq", "n", "key", "often"), "bands")
    differ = F.floor((1 - threshold) * F.col("n") + 1e-6)
    rarest = F.row_number().over(Window.partitionBy("seq").orderBy("often", "key"))
    rare = counted.withColumn("r", rarest).where((F.col("r") <= differ + 1) & (F.col("often") > 1))
    starts = keys.where("role = 'start'").join(shorts.select("key").distinct(), "key", "left_semi")
    columns = ["seq", "n", "key"]
    return Sides(stored(rare.select(columns).unionByName(shorts.select(columns)), "wanted"), stored(counted.where("often > 1").select(columns).unionByName(starts.select(columns)), "known"))


def met(wanted: DataFrame, known: DataFrame, which: Column | None = None) -> DataFrame:
    """(i, j), i > j: pairs that share a key, each once; which tells, from the columns of the greater one (i_) and of the
    smaller one (j_), which of them count."""
    more = [c for c in wanted.columns if c not in ("seq", "n", "key")]
    a, b = (rows.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("seq", "n", *more)]) for s, rows in (("a", wanted), ("b", known)))
    later = F.col("a_seq") > F.col("b_seq")
    once = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & later)
    # nothing but numbers goes through the join
    rows = a.join(b, "key").where(once & (F.col("a_seq") != F.col("b_seq")))
    of = [F.when(later, F.col(f"{s}_{c}")).otherwise(F.col(f"{t}_{c}")).alias(f"{k}_{c}") for k, s, t in (("i", "a", "b"), ("j", "b", "a")) for c in ("seq", *more)]
    rows = rows.select(*of)
    return (rows if which is None else rows.where(which)).select(F.col("i_seq").alias("i"), F.col("j_seq").alias("j")).distinct()


def enough_bands(pairs: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs (i, j) of which so many bands agree as more than threshold of the shorter one's positions need; by
    hashes, so that texts are brought only to pairs that are near."""
    n = F.size("tokens")
    band = F.transform(F.sequence(F.lit(1), F.floor(n / BAND).cast("int")), lambda b: F.xxhash64(F.slice("tokens", (b - 1) * BAND + 1, BAND)))
    rows = stored(seqs.select("seq", n.alias("n"), F.when(n >= BAND, band).otherwise(F.array().cast("array<long>")).alias("bands")), "hashes")
    a, b = (rows.select(F.col("seq").alias(c), F.col("n").alias(f"{c}_n"), F.col("bands").alias(f"{c}_bands")) for c in "ij")
    least = F.least("i_n", "j_n")
    same = F.aggregate(F.zip_with("i_bands", "j_bands", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    return pairs.join(a, "i").join(b, "j").where(same >= F.floor(least / BAND) - F.floor((1 - threshold) * least + 1e-6)).select("i", "j")


def near_pairs(pairs: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    return identical_enough(stored(enough_bands(pairs, seqs, threshold), "pairs"), seqs, threshold)


def identity_pairs(seqs: DataFrame, threshold: float = IDENTITY) -> DataFrame:
    """(i, j, same, si), i > j: pairs with more than threshold of the shorter one's positions equal.

    Candidates share a rare band at the same place, or, where the shorter one has no whole band, its whole length."""
    found = sides(seqs, threshold)
    return near_pairs(met(found.wanted, found.known), seqs, threshold)


def leader_links(seqs: DataFrame, threshold: float = IDENTITY) -> DataFrame:
    """(i, j), i > j: of identity_pairs those by which leaders tells the leaders: a sequence that no earlier one shares a
    key with leads. What is near to one of these never leads, so it is met as an earlier one no more, and its own leader
    can only be an earlier one still. So many near copies of one text are a row each, not all their pairs."""
    found = sides(seqs, threshold)
    earliest = [rows.groupBy("key").agg(F.min("seq").alias("first")) for rows in (found.known, found.wanted)]
    later = [rows.join(first, "key").where("first < seq").select("seq") for rows, first in zip((found.wanted, found.known), earliest, strict=True)]
    sure = stored(seqs.select("seq").join(later[0].unionByName(later[1]).distinct(), "seq", "left_anti"), "sure")
    told = [rows.join(sure.withColumn("sure", F.lit(True)), "seq", "left").withColumn("sure", F.coalesce("sure", F.lit(False))) for rows in (found.wanted, found.known)]
    one, two = (rows.where("sure").drop("sure") for rows in told)
    first = stored(near_pairs(met(one, found.known).unionByName(met(found.wanted, two)).distinct(), seqs, threshold).select("i", "j"), "links")
    leader = stored(first.groupBy(F.col("i").alias("seq")).agg(F.min("j").alias("leader")), "settled")
    open_ = [rows.join(leader, "seq", "left") for rows in told]
    which = ~F.col("j_sure") & F.col("j_leader").isNull() & (F.col("i_leader").isNull() | (F.col("i_leader") > F.col("j_seq")))
    return first.unionByName(near_pairs(met(*open_, which), seqs, threshold).select("i", "j"))


def leaders(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes: (seq); links: (i, j), i > j. (seq, leader): in order of seq, a node joins the first leader that it is
    linked to, or else becomes one.

    Each round settles every node whose earlier neighbours are settled or one of whose earlier neighbours leads, the
    least unsettled node at least; so it ends, after as many rounds as the longest chain of such links."""
    links = stored(links.select("i", "j"), "links")
    linked = links.select("i").distinct()
    state = stored(nodes.select("seq").join(linked, nodes.seq == linked.i, "left").select("seq", F.when(F.col("i").isNull(), F.lit(True)).alias("leads")), "leaders")
    while not state.where("leads IS NULL").isEmpty():
        before = links.join(state.withColumnRenamed("leads", "j_leads"), links.j == state.seq).groupBy("i").agg(F.bool_or(F.coalesce("j_leads", F.lit(False))).alias("some"), F.bool_and(F.coalesce(~F.col("j_leads"), F.lit(False))).alias("none"))
        fresh = F.when(F.col("some"), F.lit(False)).when(F.col("none"), F.lit(True))
        state = stored(state.join(before, state.seq == before.i, "left").select("seq", F.coalesce("leads", fresh).alias("leads")), "leaders")
    first = links.join(state.where("leads"), links.j == state.seq).groupBy("i").agg(F.min("j").alias("leader"))
    return state.join(first, state.seq == first.i, "left").select("seq", F.when(F.col("leads"), F.col("seq")).otherwise(F.col("leader")).alias("leader"))


def most_identical(kind: np.ndarray, kinds: int) -> np.ndarray:
    """For each pair of chains, the residues that any alignment can pair with an equal one: the smaller number of each
    type, summed over types."""
    n = len(kind)
    row, col = np.nonzero(kind >= 0)
    counts = np.bincount(row * kinds + kind[row, col], minlength=n * kinds).reshape(n, kinds)
    out = np.zeros((n, n), np.int64)
    for c in counts.T:
        out += np.minimum(c[:, None], c[None])
    return out


def aligned_identity_pairs(chains: DataFrame, threshold: float, matrix: list[list[float]] | None = None, kinds: int = 32) -> DataFrame:
    """chains: (chain, family, residues). (family, i, j, same, si), i > j: pairs of a family with more than threshold of
    the shorter one's residues equal in their best alignment by types and elements; any threshold will do.

    A pair is aligned only if its numbers of residues by type allow more than threshold; no pair is lost by that. Chains
    without residues are in no pair."""
    similar = similarity_matrix(kinds, matrix)

    def run(t: Tiles) -> dict[str, np.ndarray]:
        own = self_similarities(t.kind, t.ss, np.zeros((len(t.chain), 1, 1), bool), t.length, similar)
        least = np.minimum(t.length[t.first], t.length[t.second])
        some = (least > 0) & (most_identical(t.kind, kinds)[t.first, t.second] > threshold * least)
        first, second, least = t.first[some], t.second[some], least[some]
        same = np.zeros(len(first), np.int64)
        at_once = max(1, CELLS // max(t.kind.shape[1] ** 2, 1))
        for k in range(0, len(first), at_once):
            a, b = first[k : k + at_once], second[k : k + at_once]
            scale = {c: np.where(v[a] * v[b] > 0, 1 / np.sqrt(np.maximum(v[a] * v[b], 1e-12)), 0.0)[:, None, None] for c, v in own.items()}
            sim = TERM_WEIGHTS["seq"] * scale["seq"] * similar[t.kind[a][:, :, None], t.kind[b][:, None]]
            sim += ELEMENT_WEIGHT * scale["ss"] * ELEMENT_SIMILARITY[t.ss[a][:, :, None], t.ss[b][:, None]]
            partner = affine_partners(10 * sim, t.length[a], t.length[b], GAP_OPEN_FIRST)[1]
            same[k : k + at_once] = ((np.take_along_axis(t.kind[b], np.maximum(partner, 0), axis=1) == t.kind[a]) & (partner >= 0)).sum(axis=1)
        on = same > threshold * least
        return {"i": t.chain[first[on]], "j": t.chain[second[on]], "same": same[on].astype(np.int32), "si": same[on] / least[on]}

    return over_pairs(chains, ["residues"], run, "i long, j long, same int, si double", tile=SEARCH_TILE)


def aligned_leaders(chains: DataFrame, threshold: float, matrix: list[list[float]] | None = None, kinds: int = 32) -> DataFrame:
    """(chain, leader): in order of chain, a chain joins the first leader of its family that it is identical enough to,
    or else becomes one."""
    links = stored(aligned_identity_pairs(chains, threshold, matrix, kinds), "links")
    return leaders(chains.select(F.col("chain").alias("seq")), links).withColumnRenamed("seq", "chain")


def leader_clusters(docs: DataFrame, threshold: float = IDENTITY) -> DataFrame:
    """(seq, leader, copies) of every different sequence."""
    seqs = stored(distinct_sequences(docs), "sequences")
    found = leaders(seqs, leader_links(seqs, threshold))
    return found.join(seqs.select("seq", "copies"), "seq")


def contained(items: DataFrame, docs: DataFrame, seed: int = 8) -> DataFrame:
    """items: (item_id, text). (item_id, doc_id, at): where the whole token sequence of an item stands in a document,
    first place only. Items are met by a hash of their first tokens, so documents are never crossed with items."""
    own = items.select("item_id", tokens(F.col("text")).alias("it")).where(F.size("it") > 0)
    own = own.withColumn("m", F.least(F.size("it"), F.lit(seed))).withColumn("key", F.xxhash64("m", F.slice("it", F.lit(1), F.col("m"))))
    lengths = own.select("m").distinct()
    rows = docs.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    sized = rows.join(F.broadcast(lengths), F.size("tokens") >= F.col("m"))  # at most seed different lengths
    grams = sized.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("tokens") - F.col("m") + 1), lambda p: F.xxhash64("m", F.slice("tokens", p, F.col("m"))))).alias("at", "key"))
    near = grams.join(own.select("item_id", "key", "it"), "key")
    whole = near.join(rows, "doc_id").where(F.slice("tokens", F.col("at") + 1, F.size("it")) == F.col("it"))
    return whole.groupBy("item_id", "doc_id").agg(F.min("at").alias("at"))
