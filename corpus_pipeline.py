"""A training-corpus pipeline over documents: reject toxic texts, keep one of each group of near copies, redact secrets,
mix the sources to target weights, and encode what is left.

Every stage but the last returns the columns of documents, and works on all that the stage before it kept.

Edge cases, for every stage: null and empty texts and null ids are rows like others (toxicity and the secret scan keep
them, they are near copies of nothing, the mix never takes a text without words); very long texts are read whole; rows
that share a doc_id but not their text are different documents; of repeated rows with words the dedup stage keeps one;
further columns of any type (maps, which can't be ordered, too), whatever their names, are carried through unchanged; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import jaccard, mixing, pieces, queries, secrets, toxicity
from braidwork.llm.blocks import WORD
from braidwork.session import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier clean than toxic; the model is fitted on the table labels."""
    names = docs.columns
    # the scores get their own names, whatever the columns of docs are called
    plain = docs.toDF(*[n if n in ("doc_id", "text") else f"c{k}" for k, n in enumerate(names)])
    scored = toxicity.score_severity(plain, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(~F.col("toxic")).select(*plain.columns).toDF(*names)


def _order_of_equals(docs: DataFrame) -> Column:
    """A hash of the further columns of row, which tells apart rows of equal id and text."""
    further = [F.col(f"row.`{n}`") for n in docs.columns if n.lower() not in ("doc_id", "text")]
    return F.xxhash64(F.to_json(F.struct(*further))) if further else F.lit(0).cast("long")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near copies (null ids last, then by text), as one row; of repeated
    rows the one of least hash of its further columns. Texts without words are in no class and stay."""
    keys = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_key"]
    classes = jaccard.similarity_classes(docs).where("class_key IS NOT NULL").select("class_key", F.struct(*keys).alias("who"))
    first = classes.groupBy("class_key").agg(F.min("who").alias("who")).select("who.*")
    rows = docs.select(F.struct("*").alias("row"), *keys[:2], F.xxhash64("text").alias("text_key"), F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False)).alias("worded"))
    kept = rows.where("worded").join(first, ["no_id", "id", "text_key"], "left_semi").groupBy("no_id", "id", "text_key").agg(F.min_by("row", _order_of_equals(docs)).alias("row"))
    return kept.select("row").unionByName(rows.where("NOT worded").select("row")).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret that is not a widely copied example is replaced by a mark; n_chars follows the new text."""
    clean = secrets.redacted(docs, owner=F.col("source"), repo=F.col("doc_id"))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", "source")
    taken = mixing.mix_sources(rows, keep="row", tie=_order_of_equals(docs)).where("copies > 0")
    return taken.select("kept", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("kept.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(docs, queries.piece_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_each_group),
    ("secrets", redact_secrets),
    ("mix", mix_to_targets),
    ("sentencepiece", encode),
]

#: Learned weights, chosen paths and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return stored(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")
