"""Queries of this subpackage over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import divergence, jaccard, language, media, mixing, neighbours, ngram_lm, passages, pieces, quality, resampling, secrets, toxicity

#: The tokenizer file of op6 and of the pipeline's last stage.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def piece_model() -> bytes:
    with open(PIECE_MODEL, "rb") as f:
        return f.read()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pruned_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(_table(spark, sf_dir, "documents")).drop("repeats")


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents names no repository, so each document stands for one; its source is the owner."""
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"), owner=F.col("source"), repo=F.col("doc_id"))


def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return language.identify(_table(spark, sf_dir, "documents"), held_out)


def op5_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.score_severity(docs.select("doc_id", "text"), labels).drop("text")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(_table(spark, sf_dir, "documents"), piece_model())


def op7_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 10
    return ngram_lm.score_documents(_table(spark, sf_dir, "documents"), held_out=fold == 0, delete_fold=fold == 1)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(_table(spark, sf_dir, "documents")).drop("text_key", "class_key")


def op9_avi_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shots of every document stored as a film."""
    return media.clip_rows(media.texts_to_avi(_table(spark, sf_dir, "documents")))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op11_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out)


def op12_position_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pruned_graph_neighbours, op2_substring_dedup, op3_secret_ownership, op4_language_crf, op5_toxicity_ordinal, op6_sentencepiece, op7_deleted_interpolation, op8_ngram_jaccard, op9_avi_payload, media_clips, op10_source_mix, op11_attention_quality, op12_position_crc_resampling, op13_source_divergence)}


#: Positions of all words, the sequence of 50 from each, the least document that has it, and what a later one keeps.
OP2_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), word AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM split
), win AS (
  SELECT doc_id, p, string_agg(word, ' ') OVER run AS t, count(*) OVER run AS n
  FROM word WINDOW run AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), least_doc AS (
  SELECT md5(t) AS h, min(doc_id) AS lo FROM win WHERE n = 50 GROUP BY 1
), hit AS (
  SELECT w.doc_id, w.p FROM win w JOIN least_doc l ON md5(w.t) = l.h WHERE w.n = 50 AND l.lo < w.doc_id
), marked AS (
  SELECT word.doc_id, word.p, word.word, max(CASE WHEN hit.p IS NOT NULL THEN word.p END) OVER (PARTITION BY word.doc_id ORDER BY word.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS covered
  FROM word LEFT JOIN hit ON word.doc_id = hit.doc_id AND word.p = hit.p
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(covered) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE covered IS NULL) AS t
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""


#: Sets of 5-word runs, or of the whole text where it is shorter; pairs with 9 * common >= 4 * (a + b), which is
#: common / union >= 0.8; what the links connect.
OP8_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), gram AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + 4], ' ') END AS g
  FROM split, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(p) WHERE len(w) > 0
), size AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS content FROM gram GROUP BY 1
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM gram a JOIN gram b ON a.g = b.g WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT c.x, c.y FROM common c JOIN size a ON c.x = a.doc_id JOIN size b ON c.y = b.doc_id WHERE 9 * c.n >= 4 * (a.n + b.n)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), class AS (
  SELECT x, min(y) AS class_id FROM reach GROUP BY 1
), copy AS (
  SELECT content, min(doc_id) AS copy_of FROM size GROUP BY 1
)
SELECT d.doc_id, c.class_id, coalesce(copy.copy_of, d.doc_id) AS copy_of, (SELECT count(*) FROM link WHERE link.x = d.doc_id) AS n_links
FROM documents d JOIN class c ON d.doc_id = c.x LEFT JOIN size USING (doc_id) LEFT JOIN copy USING (content)
"""


#: Frames of 192 bytes as hexadecimal digits; histograms of the upper digit of each byte; a cut where the change exceeds
#: the mean of the up to eight changes before it by three deviations.
CLIPS_SQL = """
WITH t AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), p AS (
  SELECT doc_id, hex(b) || repeat('20', CASE WHEN octet_length(b) = 0 THEN 192 ELSE (192 - octet_length(b) % 192) % 192 END) AS h FROM t
), f AS (
  SELECT doc_id, k AS frame, substr(h, k * 384 + 1, 384) AS x FROM p, unnest(range(0, len(h) // 384)) AS u(k)
), d AS (
  SELECT doc_id, frame, array_to_string([x[2 * i + 1] FOR i IN range(0, 192)], '') AS high, list_sum([('0x' || x[2 * i + 1:2 * i + 2])::INT FOR i IN range(0, 192)]) AS total FROM f
), hist AS (
  SELECT doc_id, frame, total, [len(high) - len(replace(high, c, '')) FOR c IN string_split('0123456789ABCDEF', '')] AS n FROM d
), step AS (
  SELECT doc_id, frame, total, list_sum([abs(z[1] - z[2]) FOR z IN list_zip(n, lag(n) OVER (PARTITION BY doc_id ORDER BY frame))])::DOUBLE AS change FROM hist
), seen AS (
  SELECT *, count(change) OVER w AS m, sum(change) OVER w AS one, sum(change * change) OVER w AS two FROM step
  WINDOW w AS (PARTITION BY doc_id ORDER BY frame ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)
), cut AS (
  SELECT *, CASE WHEN frame >= 3 AND change > one / m + 3 * greatest(sqrt(greatest(two / m - (one / m) * (one / m), 0)), 1) THEN 1 ELSE 0 END AS fresh FROM seen
), clips AS (
  SELECT doc_id, frame, total, sum(fresh) OVER (PARTITION BY doc_id ORDER BY frame) AS clip FROM cut
)
SELECT doc_id, clip::INT AS clip, min(frame)::INT AS first_frame, count(*)::INT AS n_frames, min(frame) * 40 AS start_ms, (max(frame) + 1) * 40 AS end_ms, sum(total)::DOUBLE / (192 * count(*)) AS mean_sample
FROM clips GROUP BY doc_id, clip
"""


#: CRC-32 by byte with the usual table, which is made from the polynomial; once a distinct word.
OP12_SQL = r"""
WITH one AS (
  SELECT [list_reduce(range(0, 8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b) FOR b IN range(0, 256)] AS crc_of
), word AS (
  SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), feature AS (
  SELECT side, doc_id, unnest(w) AS f FROM word
), kind AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM feature)
), crc AS (
  SELECT f, xor(list_reduce([('0x' || h[2 * i + 1:2 * i + 2])::BIGINT FOR i IN range(0, len(h) // 2)], lambda c, b: xor(c >> 8, crc_of[1 + xor(c % 256, b)]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
  FROM kind, one
), bucket AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM feature JOIN crc USING (f) GROUP BY 1
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM bucket) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM bucket) + 10000)::DOUBLE)))::BIGINT AS gain FROM bucket
), weight AS (
  SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM feature JOIN crc USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1
), scored AS (
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weight USING (doc_id)
), top AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= n * 10 // 100 THEN r END AS rank FROM scored s LEFT JOIN top USING (doc_id)
"""


#: Every term of every group with its count, 0 where it has none, and whole numbers of 128 bits.
OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), groups AS (
  SELECT DISTINCT lang, source FROM d
), word AS (
  SELECT row, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM word GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY 1
), own AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM word w SEMI JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY 1, 2, 3
), totals AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM own GROUP BY 1, 2
), share AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + (1000000000 * (coalesce(o.n, 0) + 1)::HUGEINT) // (coalesce(t.total, 0) + l.v) AS p, 1 + (1000000000 * (k.n + 1)::HUGEINT) // (l.total + l.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), term AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM share WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS r FROM pair
  UNION ALL
  SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term
)
SELECT lang, source, part, item, value, r::INT AS rank FROM ranked WHERE part = 'pair' OR r <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_position_crc_resampling": OP12_SQL, "op13_source_divergence": OP13_SQL, "op2_substring_dedup": OP2_SQL, "op8_ngram_jaccard": OP8_SQL, "media_clips": CLIPS_SQL}
