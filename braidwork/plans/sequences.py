"""Sequences, link graphs and text layouts over the given tables; queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators import chains as ch
from braidwork.operators import graphs
from braidwork.operators import sequences as sq
from braidwork.plans import structure
from braidwork.plans.structure import _PAIRS
from braidwork.sources import lists

LINKS = 3


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def seq_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different texts that agree in more than 95 % of the shorter one's positions."""
    seqs = sq.stored(sq.distinct_sequences(_docs(spark, sf_dir)), "sequences")
    return sq.identity_pairs(seqs).select("i", "j", "same", F.round("si", 6).alias("si"))


def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.leader_clusters(_docs(spark, sf_dir))


def subsequence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text as one run of words."""
    return sq.contained(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _docs(spark, sf_dir)).select("item_id", "doc_id", "at")


def fasta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ASCII letters written as FASTA records of 60 columns, and scanned again."""
    rows = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")).alias("seq")).where("seq <> ''")
    got = lists.parse_fasta(lists.fasta_texts(rows))
    return got.select(F.col("name").cast("long").alias("doc_id"), F.length("seq").alias("n"), F.md5("seq").alias("seq_md5"))


def list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a line of a structure list, scanned again."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    line = F.format_string("p%d A 1-%d,%d-%d", F.col("p_partkey"), F.col("p_size"), F.col("p_size") + 5, F.col("p_size") + 9)
    got = lists.parse_list(p.select(F.lit("parts").alias("file"), F.col("p_partkey").alias("no"), line.alias("line")))
    return got.select("code", "chain", "domname", F.size("frags").alias("n_frags"), F.aggregate("frags", F.lit(0), lambda s, f: s + f["end"] - f["ini"] + 1).alias("n_sites"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = ch.best_links(structure.score_chains(spark, sf_dir), LINKS).select("chain", "other", "score")
    return graphs.stored(graphs.top_links(ends, LINKS), "graph")


def link_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.degrees(_links(spark, sf_dir))


def two_hop_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.two_hop(_links(spark, sf_dir))


def triangle_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.ranked(graphs.triangles(_links(spark, sf_dir)), "triangles")


def single_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.single_linkage(structure.vectors(spark, sf_dir).select(F.col("vec_id").alias("node")), _links(spark, sf_dir))


def max_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.maximal_cliques(_links(spark, sf_dir))


_SPLIT = r"tok AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), seqs AS (SELECT min(doc_id) AS seq, w FROM tok WHERE len(w) > 0 GROUP BY w)"
_LINK = f"""{_PAIRS}, ends AS (SELECT i AS chain, j AS other, round(tm, 6) AS s FROM pairs UNION ALL SELECT j, i, round(tm, 6) FROM pairs), top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY s DESC, other) AS r FROM ends) WHERE r <= {LINKS}
), link AS (SELECT DISTINCT least(chain, other) AS a, greatest(chain, other) AS b FROM top), l2 AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link)"""
#: Cliques grow by later nodes among the common neighbours; those without any left are maximal.
_CLIQUES = f"""{_LINK}, nb AS (SELECT a, list(b ORDER BY b) AS n FROM l2 GROUP BY a), grow AS (
  SELECT [a] AS members, n AS common, a AS latest FROM nb
  UNION ALL
  SELECT list_append(g.members, g.x), list_intersect(g.common, nb.n), g.x FROM (SELECT members, common, latest, unnest(common) AS x FROM grow) g JOIN nb ON nb.a = g.x WHERE g.x > g.latest
), cliques AS (SELECT members[1] AS seed, len(members)::INT AS size, array_to_string(members, ',') AS nodes FROM grow WHERE len(common) = 0 AND len(members) >= 3)"""
_SAME = """pos AS (SELECT seq, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM seqs), common AS (
  SELECT a.seq AS i, b.seq AS j, count(*) AS same, least(any_value(a.n), any_value(b.n)) AS m FROM pos a JOIN pos b ON a.p = b.p AND a.t = b.t AND a.seq > b.seq GROUP BY 1, 2
)"""

SQL = {
    "max_cliques": f"WITH RECURSIVE {_CLIQUES} SELECT seed, size, nodes FROM cliques",
    "leader_clusters": f"""WITH RECURSIVE {_SPLIT}, {_SAME}, links AS (SELECT i, list(j) AS js FROM common WHERE same/m::DOUBLE > 0.95 GROUP BY i), turn AS (
  SELECT seq, coalesce(js, []) AS js, row_number() OVER (ORDER BY seq) AS r FROM seqs LEFT JOIN links ON seqs.seq = links.i
), walk AS (
  SELECT r, seq, seq AS leader, [seq] AS leaders FROM turn WHERE r = 1
  UNION ALL
  SELECT t.r, t.seq, coalesce(list_min(list_intersect(w.leaders, t.js)), t.seq), CASE WHEN list_min(list_intersect(w.leaders, t.js)) IS NULL THEN list_append(w.leaders, t.seq) ELSE w.leaders END FROM walk w JOIN turn t ON t.r = w.r + 1
), copy AS (SELECT min(doc_id) AS seq, count(*) AS copies FROM tok WHERE len(w) > 0 GROUP BY w)
SELECT walk.seq, leader, copies FROM walk JOIN copy ON walk.seq = copy.seq""",
    "seq_identity": f"WITH {_SPLIT}, {_SAME} SELECT i, j, same::INT AS same, round(same/m::DOUBLE, 6) AS si FROM common WHERE same/m::DOUBLE > 0.95",
    "subsequence_match": r"""WITH d AS (SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), ' ') AS t FROM documents), b AS (SELECT item_id, array_to_string(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), ' ') AS t FROM benchmark)
SELECT item_id, doc_id, (len(string_split((' ' || d.t || ' ')[1:strpos(' ' || d.t || ' ', ' ' || b.t || ' ')], ' ')) - 2)::INT AS at FROM d JOIN b ON contains(' ' || d.t || ' ', ' ' || b.t || ' ')""",
    "fasta_scan": "SELECT doc_id, length(s)::INT AS n, md5(s) AS seq_md5 FROM (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS s FROM documents) WHERE s <> ''",
    "list_scan": "SELECT 'p' || p_partkey AS code, 'A' AS chain, 'p' || p_partkey || 'A' AS domname, 2 AS n_frags, (p_size + 5)::INT AS n_sites FROM part",
    "link_degree": f"WITH {_LINK} SELECT a AS node, count(*) AS degree, string_agg(b::VARCHAR, ',' ORDER BY b) AS neighbours FROM l2 GROUP BY 1",
    "two_hop_links": f"WITH {_LINK} SELECT a, b FROM link UNION SELECT x.a, y.b FROM l2 x JOIN l2 y ON x.b = y.a WHERE x.a < y.b",
    "triangle_rank": f"""WITH {_LINK}, tri AS (SELECT p.a AS x, p.b AS y, q.b AS z FROM link p JOIN link q ON p.a = q.a AND p.b < q.b JOIN link r ON r.a = p.b AND r.b = q.b), n AS (
  SELECT node, count(*) AS triangles FROM (SELECT x AS node FROM tri UNION ALL SELECT y FROM tri UNION ALL SELECT z FROM tri) GROUP BY 1
) SELECT node, triangles, row_number() OVER (ORDER BY triangles DESC, node) AS rank FROM n""",
    "single_linkage": f"""WITH RECURSIVE {_LINK}, reach AS (SELECT vec_id AS node, vec_id AS dest FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN l2 l ON r.dest = l.a)
SELECT node, min(dest) AS root FROM reach GROUP BY 1""",
}

QUERIES = {f.__name__: f for f in (seq_identity, leader_clusters, subsequence_match, fasta_scan, list_scan, link_degree, two_hop_links, triangle_rank, single_linkage, max_cliques)}
