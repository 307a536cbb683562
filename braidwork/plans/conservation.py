"""What chains of a family keep: counters and ratios by contact class and identity; filters and reports on pairs,
outgroups and cliques. Queries and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators import chains as ch
from braidwork.operators import conservation as co
from braidwork.operators import graphs, tables
from braidwork.operators import outgroups as outgroup
from braidwork.plans import sequences, structure
from braidwork.plans.phylogeny import _CV, _D, _OUT
from braidwork.plans.sequences import _CLIQUES
from braidwork.plans.structure import _ALL, _CONTACTS, _NEAREST, _OCTANT, _PAIRS, _SCALE2, SCORE_SCALE, _residues

EXPONENTS = (0.5, 0.7, 1.0, 1.5, 2.0)
RELATED, BAND, CLIQUE_SHARE, CLIQUE_CAP = 0.1, (0.1, 0.6), 0.35, 50
_TYPES = 8


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Chains at the scale of scores, their residues, contact edges and contact counts."""
    chains, edges = structure.score_chains(spark, sf_dir), ch.stored(structure.contact_edges(spark, sf_dir), "edges")
    return chains, ch.residue_rows(chains), edges, ch.contact_degree(edges)


def _mean(residues: DataFrame, degree: DataFrame) -> float:
    """Contacts a residue: one row."""
    return co.mean_contacts(residues, degree).first()[0] or 0.0


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains, residues, edges, degree = _parts(spark, sf_dir)
    return co.counters_in_tiles(chains, edges, _mean(residues, degree))


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def conserved_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counters(spark, sf_dir)


def conservation_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.conservation_ratios(_counters(spark, sf_dir)).select("class", "what", *_r("value", "se"))


def contact_end_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains, residues, edges, degree = _parts(spark, sf_dir)
    ends = co.ends_in_tiles(chains, edges, _mean(residues, degree))
    return co.contact_ratios(ends).select("kind", "k", *_r("p", "se", "vs_mean", "vs_se"))


def identity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = co.identity_table(_counters(spark, sf_dir))
    return t.select("bin", "n", *_r(*[c for c in t.columns if c not in ("bin", "n")]))


def unaligned_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues that no anchor aligns, by contact class."""
    chains, residues, edges, degree = _parts(spark, sf_dir)
    return co.unaligned_in_tiles(chains, edges, _mean(residues, degree))


def composed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chain aligned with its nearest one through the medoid of their family."""
    chains = structure.score_chains(spark, sf_dir)
    medoids = ch.stored(structure.conformation_medoid(spark, sf_dir).select(F.col("medoid").alias("j")), "medoids")
    marked = chains.join(F.broadcast(medoids.withColumn("marked", F.lit(True))), F.col("chain") == F.col("j"), "left").drop("j").withColumn("marked", F.coalesce("marked", F.lit(False)))
    anchors = ch.stored(ch.anchors_with(marked), "anchors")
    both = anchors.select("i", "j", "p", "q").unionByName(co.inverse(anchors))
    pairs = structure.nearest_neighbour(spark, sf_dir).select(F.col("chain").alias("i"), F.col("best").alias("j"))
    to_medoid = both.join(F.broadcast(medoids), "j")  # one row for each family
    return co.compose(to_medoid, co.inverse(to_medoid), pairs).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p_sum"), F.sum("q").alias("q_sum"))


def _type_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.propensities(ch.type_counts(structure.score_chains(spark, sf_dir), 0.25, 5), least=4)


def type_propensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much oftener than by chance two types are aligned, by divergence of the chains."""
    return _type_matrix(spark, sf_dir).select("bin", "a", "b", "n", F.round("propensity", 6).alias("propensity"))


def self_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of each chain's residues with themselves, by the propensities of the last bin."""
    # stored, so that no broadcast waits for the pass over pairs
    matrix = ch.stored(_type_matrix(spark, sf_dir).where("bin = 4").select("a", "b", F.col("propensity").alias("s")), "matrix")
    rows = ch.residue_rows(structure.score_chains(spark, sf_dir))
    return co.self_scores(rows, F.broadcast(matrix)).select("family", "chain", *_r("score"))  # one row for each pair of types


def score_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest and least score between groups of chains that begin with the same residue type, in each family."""
    chains = structure.score_chains(spark, sf_dir)
    return ch.group_extrema(chains.withColumn("member_of", (F.col("family") * _TYPES + F.get("residues", F.lit(0))["aa"]).cast("long")))


def related_outgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outgroups of the pairs of at most 10 % identity that are related to both of their chains."""
    return outgroup.related_counts(structure.score_chains(spark, sf_dir), RELATED)


def band_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of the pairs whose contact overlap is unknown (none) or within a band."""
    found = ch.band_counts(structure.score_chains(spark, sf_dir), structure.contact_edges(spark, sf_dir), *BAND, 0.05, 20)
    return found.select("bin", "n", F.round("total", 4).alias("total"))


def cv_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock violations as powers of the divergence, by bin of it."""
    cv = outgroup.clock_violations(structure.score_chains(spark, sf_dir))
    s = tables.scaled_violations(cv.withColumns({"cv": F.round("cv", 6), "t": F.round("t", 6)}), EXPONENTS, F.floor("d").cast("int"))
    return s.select("bin", "exponent", "n", F.round("mean", 4).alias("mean"), F.round("se", 4).alias("se"), "significant")


def gap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of outgroup triples that break the triangle inequality, by the gaps between the anchors of the pair."""
    def bin_of(k: outgroup.Pairs) -> np.ndarray:
        gaps = outgroup.anchor_breaks(k)
        return np.where(gaps < 0, -1, np.minimum(gaps, 40) // 5)

    f = tables.counted_frequencies(outgroup.violation_counts(structure.score_chains(spark, sf_dir), bin_of), ["bin"])
    return f.select("bin", "n", "hits", *_r("p", "se"))


def best_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of score with the greatest mean in each family."""
    return tables.best_round(structure.mean_scores(spark, sf_dir).where("what <> 'n_ali'"), "family", "what", "mean")


def clique_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.select_cliques(sequences.max_cliques(spark, sf_dir), CLIQUE_SHARE, CLIQUE_CAP)


_ANCHOR_ROWS = f"""{_residues(SCORE_SCALE)}, dd AS (
  SELECT a.family, a.chain AS i, b.chain AS j, a.res AS p, b.res AS q, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2
  FROM res a JOIN res b ON a.family = b.family AND a.chain > b.chain
), mm AS (
  SELECT family, i, j, p, q FROM (SELECT *, row_number() OVER (PARTITION BY i, j, p ORDER BY d2, q) AS rp, row_number() OVER (PARTITION BY i, j, q ORDER BY d2, p) AS rq FROM dd) WHERE rp = 1 AND rq = 1
), anc AS MATERIALIZED (
  SELECT family, i, j, p, q FROM (SELECT *, max(q) OVER (PARTITION BY i, j ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM mm) WHERE before IS NULL OR q > before
)"""
_DEGREE = """ends2 AS (SELECT chain, i AS res FROM edges UNION ALL SELECT chain, j FROM edges), deg AS (SELECT chain, res, count(*) AS n FROM ends2 GROUP BY 1, 2), mean AS (
  SELECT (SELECT count(*) FROM ends2)/(SELECT count(*) FROM res2)::DOUBLE AS m
)"""
_ALIGNED = f"""{_CONTACTS}, {_ANCHOR_ROWS}, {_DEGREE}, typed AS (
  SELECT r.*, {_OCTANT.format('r')} AS aa, coalesce(d.n, 0) AS n FROM res r LEFT JOIN deg d ON d.chain = r.chain AND d.res = r.res
), al AS MATERIALIZED (
  SELECT a.family, a.chain AS i, b.chain AS j, a.res AS p, a.aa = b.aa AS same, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) < 0.5*({_SCALE2}) AS sup,
    coalesce(k.q = a.res, false) AS neigh, abs(k.q - a.res) AS shift, CASE WHEN sqrt((a.n*b.n)::DOUBLE) > (SELECT m FROM mean) THEN 'many' ELSE 'few' END AS class, a.n*b.n AS nn
  FROM typed a JOIN typed b ON a.family = b.family AND a.res = b.res AND a.chain > b.chain LEFT JOIN anc k ON k.i = a.chain AND k.j = b.chain AND k.p = a.res
), bins AS (SELECT i, j, (count(*) FILTER (same)*10 // count(*))::INT AS bin FROM al GROUP BY 1, 2
), cont AS MATERIALIZED (
  SELECT x.i, x.j, CASE WHEN x.nn*y.nn > pow((SELECT m FROM mean), 4) THEN 'many' ELSE 'few' END AS class, x.sup::INT + y.sup::INT AS n_sup, x.same::INT + y.same::INT AS n_ide, k.chain IS NOT NULL AS kept
  FROM edges e JOIN al x ON x.i = e.chain AND x.p = e.i JOIN al y ON y.i = e.chain AND y.j = x.j AND y.p = e.j LEFT JOIN edges k ON k.chain = x.j AND k.i = e.i AND k.j = e.j
), c1 AS (
  SELECT class, bin, count(*) AS n_ali, count(*) FILTER (sup) AS n_sup, count(*) FILTER (same) AS n_ide, count(*) FILTER (same AND sup) AS n_ide_sup, count(*) FILTER (NOT same AND NOT sup) AS n_neither, count(*) FILTER (neigh) AS n_neigh,
    count(*) FILTER (shift IS NOT NULL AND NOT neigh) AS n_neigh_noali, count(*) FILTER (shift IS NOT NULL AND NOT neigh AND same) AS n_neigh_noali_ide, count(*) FILTER (sup AND NOT neigh) AS n_sup_noneigh,
    coalesce(sum(shift) FILTER (sup AND NOT neigh), 0)::BIGINT AS shift_sup_noneigh
  FROM al JOIN bins USING (i, j) GROUP BY 1, 2
), c2 AS (SELECT class, bin, count(*) AS ali_cont, count(*) FILTER (kept) AS id_cont FROM cont JOIN bins USING (i, j) GROUP BY 1, 2
), cnt AS (
  SELECT class, bin, coalesce(n_ali, 0) AS n_all, coalesce(n_ali, 0) AS n_ali, coalesce(n_sup, 0) AS n_sup, coalesce(n_ide, 0) AS n_ide, coalesce(n_ide_sup, 0) AS n_ide_sup, coalesce(n_neither, 0) AS n_neither, coalesce(n_neigh, 0) AS n_neigh,
    coalesce(n_neigh_noali, 0) AS n_neigh_noali, coalesce(n_neigh_noali_ide, 0) AS n_neigh_noali_ide, coalesce(n_sup_noneigh, 0) AS n_sup_noneigh, coalesce(shift_sup_noneigh, 0) AS shift_sup_noneigh, coalesce(ali_cont, 0) AS ali_cont, coalesce(id_cont, 0) AS id_cont
  FROM c1 FULL JOIN c2 USING (class, bin)
)"""


def _p(c: str, t: str) -> str:
    return f"(CASE WHEN {t} > 0 THEN ({c})/({t})::DOUBLE ELSE 0.0 END)"


def _re(c: str, t: str) -> str:
    return f"(CASE WHEN {c} > 0 THEN greatest(1-{_p(c, t)}, 0)/({c}) ELSE 1.0 END)"


def _se(c: str, t: str) -> str:
    return f"(CASE WHEN {c} > 0 THEN {_p(c, t)}*sqrt({_re(c, t)}) ELSE 0.0 END)"


def _ratio_rows() -> str:
    rows = [f"SELECT class, '{w}' AS what, {_p(c, t)} AS value, {_se(c, t)} AS se FROM byc" for w, (c, t) in co.RATES.items()]
    rows.append("SELECT class, 'mean_shift_sup_noneigh', CASE WHEN n_sup_noneigh > 0 THEN shift_sup_noneigh/n_sup_noneigh::DOUBLE ELSE 0.0 END, 0.0 FROM byc")
    four = {"sup_if_ide_vs_noide": ("n_ide_sup", "n_ide", "(n_sup-n_ide_sup)", "(n_ali-n_ide)"), "nosup_if_noide_vs_ide": ("n_neither", "(n_ali-n_ide)", "(n_ide-n_ide_sup)", "n_ide"), "ide_if_sup_vs_nosup": ("n_ide_sup", "n_sup", "(n_ide-n_ide_sup)", "(n_ali-n_sup)"), "noide_if_nosup_vs_sup": ("n_neither", "(n_ali-n_sup)", "(n_sup-n_ide_sup)", "n_sup")}
    for w, (c1, t1, c2, t2) in four.items():
        ratio = f"CASE WHEN {_p(c2, t2)} > 0 THEN {_p(c1, t1)}/{_p(c2, t2)} END"
        rows.append(f"SELECT class, '{w}', {ratio}, {ratio}*sqrt({_re(c1, t1)}+{_re(c2, t2)}) FROM byc")
    return " UNION ALL ".join(rows)


_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("n_all", "n_ali", "n_sup", "n_ide", "n_ide_sup", "n_neither", "n_neigh", "n_neigh_noali", "n_neigh_noali_ide", "n_sup_noneigh", "shift_sup_noneigh", "ali_cont", "id_cont"))
_TABLE = ", ".join(f"round({f(c, t)}, 6) AS {p}_{n}" for n, c, t in (("ide", "n_ide", "n_ali"), ("sup", "n_sup", "n_ali"), ("neigh", "n_neigh", "n_ali"), ("cont", "id_cont", "ali_cont")) for p, f in (("p", _p), ("se", _se)))
_MATRIX = f"""{_D}, typed AS (SELECT r.*, {_OCTANT.format('r')} AS aa FROM res r), c AS (
  SELECT least(floor(round(d.d, 6)/0.25), 4)::INT AS bin, a.aa AS a, b.aa AS b, count(*) AS n FROM typed a JOIN typed b ON a.family = b.family AND a.res = b.res AND a.chain > b.chain JOIN d ON d.i = a.chain AND d.j = b.chain GROUP BY 1, 2, 3
), s AS (SELECT bin, a, b, sum(n)::BIGINT AS n FROM (SELECT * FROM c UNION ALL SELECT bin, b, a, n FROM c) GROUP BY 1, 2, 3
), st AS (SELECT DISTINCT bin, a FROM s), g AS (
  SELECT x.bin, x.a, y.a AS b, coalesce(s.n, 0) AS n FROM st x JOIN st y ON x.bin = y.bin LEFT JOIN s ON s.bin = x.bin AND s.a = x.a AND s.b = y.a
), tot AS (SELECT *, sum(n) OVER (PARTITION BY bin, a) AS fa, sum(n) OVER (PARTITION BY bin, b) AS fb, sum(n) OVER (PARTITION BY bin) AS total FROM g
), prop AS (SELECT bin, a, b, n, CASE WHEN n > 0 THEN ln(total*n/(fa*fb)::DOUBLE) ELSE -ln(10.0) END AS propensity FROM tot WHERE total >= 8)"""
_MEDOID = """sums AS (SELECT family, chain, round(sum(tm), 6) AS total FROM (SELECT family, i AS chain, tm FROM pairs UNION ALL SELECT family, j, tm FROM pairs) GROUP BY 1, 2), medoid AS (
  SELECT chain FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY total DESC, chain) AS r FROM sums) WHERE r = 1
)"""
SQL = {
    "conserved_counters": f"WITH {_ALIGNED} SELECT * FROM cnt",
    "conservation_ratios": f"WITH {_ALIGNED}, byc AS (SELECT class, {_SUMS} FROM cnt GROUP BY 1 UNION ALL SELECT 'all', {_SUMS} FROM cnt), long AS ({_ratio_rows()}) SELECT class, what, round(value, 6) AS value, round(se, 6) AS se FROM long",
    "contact_end_ratios": f"""WITH {_ALIGNED}, e AS (SELECT 'sup' AS kind, n_sup AS k, kept FROM cont UNION ALL SELECT 'ide', n_ide, kept FROM cont), n AS (SELECT kind, k, count(*) AS ali, count(*) FILTER (kept) AS ide FROM e GROUP BY 1, 2
), v AS (SELECT kind, sum(ali) AS a0, sum(ide) AS i0 FROM n GROUP BY 1), w AS (SELECT * FROM n JOIN v USING (kind))
SELECT kind, k, round({_p('ide', 'ali')}, 6) AS p, round({_se('ide', 'ali')}, 6) AS se, round({_p('ide', 'ali')}/{_p('i0', 'a0')}, 6) AS vs_mean, round({_p('ide', 'ali')}/{_p('i0', 'a0')}*sqrt({_re('ide', 'ali')}+{_re('i0', 'a0')}), 6) AS vs_se FROM w""",
    "identity_table": f"WITH {_ALIGNED}, byb AS (SELECT bin, {_SUMS} FROM cnt GROUP BY 1) SELECT bin, n_ali AS n, {_TABLE} FROM byb WHERE n_ali >= 10",
    "unaligned_by_class": f"""WITH {_CONTACTS}, {_ANCHOR_ROWS}, {_DEGREE}, typed AS (
  SELECT r.chain, r.res, CASE WHEN coalesce(d.n, 0) > (SELECT m FROM mean) THEN 'many' ELSE 'few' END AS class FROM res r LEFT JOIN deg d ON d.chain = r.chain AND d.res = r.res
), pr AS (SELECT DISTINCT family, i, j FROM anc), un AS (
  SELECT pr.family, pr.i, pr.j, t.class, count(*) AS n FROM pr JOIN typed t ON t.chain = pr.j LEFT JOIN anc k ON k.i = pr.i AND k.j = pr.j AND k.q = t.res WHERE k.q IS NULL GROUP BY 1, 2, 3, 4
) SELECT family, class, sum(n)::BIGINT AS n, count(*) AS pairs FROM un GROUP BY 1, 2""",
    "composed_alignment": f"""WITH {_PAIRS}, {_ANCHOR_ROWS.split(', dd AS (', 1)[1].join(['dd AS (', ''])}, {_NEAREST}, {_MEDOID}, al AS (SELECT i, j, p, q FROM anc UNION ALL SELECT j, i, q, p FROM anc), tom AS (SELECT al.* FROM al JOIN medoid ON al.j = medoid.chain)
SELECT x.i, y.i AS j, count(*) AS n, sum(x.p)::BIGINT AS p_sum, sum(y.p)::BIGINT AS q_sum FROM best b JOIN tom x ON x.i = b.chain JOIN tom y ON y.i = b.best AND y.j = x.j AND y.q = x.q GROUP BY 1, 2""",
    "type_propensity": f"WITH {_MATRIX} SELECT bin, a, b, n, round(propensity, 6) AS propensity FROM prop",
    "self_score": f"WITH {_MATRIX} SELECT t.family, t.chain, round(avg(coalesce(p.propensity, 0.0)), 6) AS score FROM typed t LEFT JOIN prop p ON p.bin = 4 AND p.a = t.aa AND p.b = t.aa GROUP BY 1, 2",
    "score_extrema": f"""WITH {_PAIRS}, g AS (SELECT r.chain, r.family*8 + {_OCTANT.format('r')} AS g FROM res r WHERE r.res = 0), m AS (
  SELECT least(a.g, b.g) AS a, greatest(a.g, b.g) AS b, p.i, p.j, round(p.tm, 6) AS tm FROM pairs p JOIN g a ON a.chain = p.i JOIN g b ON b.chain = p.j
), x AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY tm DESC, i, j) AS hi, row_number() OVER (PARTITION BY a, b ORDER BY tm, i, j) AS lo, count(*) OVER (PARTITION BY a, b) AS n FROM m)
SELECT u.a, u.b, u.n, u.tm AS most, u.i AS most_i, u.j AS most_j, v.tm AS least, v.i AS least_i, v.j AS least_j FROM x u JOIN x v ON u.a = v.a AND u.b = v.b WHERE u.hi = 1 AND v.lo = 1""",
    "related_outgroups": f"""WITH {_OUT}, si2 AS (SELECT i, j, si FROM d UNION ALL SELECT j, i, si FROM d)
SELECT o.family, o.i, o.j, count(*) AS n_out FROM outg o JOIN d ON d.i = o.i AND d.j = o.j JOIN si2 x ON x.i = o.i AND x.j = o.k JOIN si2 y ON y.i = o.j AND y.j = o.k WHERE d.si <= {RELATED} AND x.si >= {RELATED} AND y.si >= {RELATED} GROUP BY 1, 2, 3""",
    "band_histogram": f"""WITH {_ALL}, k AS (SELECT round(tm, 6) AS tm, CASE WHEN co > 0 THEN round(co, 6) END AS known FROM every)
SELECT least(floor(tm/0.05), 19)::INT AS bin, count(*) AS n, round(sum(tm), 4) AS total FROM k WHERE known IS NULL OR known BETWEEN {BAND[0]} AND {BAND[1]} GROUP BY 1""",
    "cv_scaling": f"""WITH {_CV}, r AS (SELECT floor(d)::INT AS bin, round(cv, 6) AS cv, d, round(t, 6) AS t, e.x AS exponent FROM cv, (SELECT unnest([{', '.join(f'{e}::DOUBLE' for e in EXPONENTS)}]) AS x) e WHERE d > 0 AND cv IS NOT NULL
), q AS (SELECT *, abs(cv)/pow(d, exponent) AS acc FROM r)
SELECT bin, exponent, count(*) AS n, round(avg(acc), 4) AS mean, round(CASE WHEN count(*) > 1 THEN sqrt(greatest(avg(acc*acc)-avg(acc)*avg(acc), 0)/(count(*)-1)) ELSE 0.0 END, 4) AS se, count(*) FILTER (t <> 0 AND acc*acc*(1-1/(t*t)) > 0.15*0.15) AS significant FROM q GROUP BY 1, 2""",
    "gap_violations": f"""WITH {_OUT}, {_ANCHOR_ROWS.split(', dd AS (', 1)[1].join(['dd AS (', ''])}, gaps AS (
  SELECT i, j, count(*) FILTER (off) AS gaps FROM (SELECT i, j, p <> lag(p) OVER w + 1 OR q <> lag(q) OVER w + 1 AS off FROM anc WINDOW w AS (PARTITION BY i, j ORDER BY p)) GROUP BY 1, 2
), f AS (SELECT (least(gaps, 40)//5)::INT AS bin, count(*) AS n, count(*) FILTER (abs(dik-djk) > dij) AS hits FROM outg JOIN gaps USING (i, j) GROUP BY 1)
SELECT bin, n, hits, round({_p('hits', 'n')}, 6) AS p, round({_se('hits', 'n')}, 6) AS se FROM f""",
    "clique_selection": f"""WITH RECURSIVE {_CLIQUES}, big AS (SELECT * FROM cliques WHERE size > {CLIQUE_SHARE}*(SELECT max(size) FROM cliques))
SELECT seed, size, nodes FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY seed, nodes) AS r FROM big) WHERE r <= {CLIQUE_CAP}""",
    "best_round": f"""WITH {_ALL}, l AS (UNPIVOT (SELECT family, si::DOUBLE AS si, tm::DOUBLE AS tm, co::DOUBLE AS co, pc::DOUBLE AS pc FROM every) ON si, tm, co, pc INTO NAME what VALUE v), m AS (SELECT family, what, round(avg(v), 6) AS mean FROM l GROUP BY 1, 2)
SELECT family, what, mean FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY mean DESC, what) AS r FROM m) WHERE r = 1""",
}

QUERIES = {
    f.__name__: f
    for f in (conserved_counters, conservation_ratios, contact_end_ratios, identity_table, unaligned_by_class, composed_alignment, type_propensity, self_score, score_extrema, related_outgroups, band_histogram, cv_scaling, gap_violations, best_round, clique_selection)
}
