"""Streams: running contingency counts, and leaders and their clusters kept up to date as new sequences arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from braidwork.operators import sequences
from braidwork.operators.sequences import IDENTITY, WORD
from braidwork.session import stored


def windowed_counts(events: DataFrame, time: str, state: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, state, n) of an unbounded stream: events by time window, closed once the watermark has passed."""
    seen = events.withWatermark(time, late)
    return seen.groupBy(F.window(time, width).alias("w"), F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "state", "n")


def first_of_each(texts: DataFrame, time: str, late: str = "2 hours") -> DataFrame:
    """Stream of texts without those whose token sequence came before within the watermark."""
    key = F.xxhash64(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})")))
    return texts.withColumn("token_key", key).withWatermark(time, late).dropDuplicatesWithinWatermark(["token_key"]).drop("token_key")


def keep_leaders(texts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to path the leaders, sequences that no earlier one equals, of each micro-batch.

    A batch meets the leaders known so far by a hash join; a batch that is run again after a failure adds nothing new,
    as its sequences are known by then."""

    def add(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"))
        rows = batch.withColumn("leader_key", F.xxhash64(tokens))
        own = rows.groupBy("leader_key").agg(F.min("doc_id").alias("doc_id"))
        try:
            known = spark.read.schema("leader_key long, doc_id long").parquet(path)
            own = own.join(known.select("leader_key"), "leader_key", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        stored(own, "leaders").write.mode("append").parquet(path)

    return texts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What keep_clusters knows: sequences with the leader of each, and of the leaders the tokens and the keys they are met by.
_SEQUENCES, _LEADERS, _KEYS = "token_key long, seq long, leader long, copies long", "seq long, tokens array<string>", "seq long, key long, role string"


def _known(spark: SparkSession, path: str, table: str, schema: str, before: int) -> DataFrame:
    """What batches before this one have written."""
    empty = spark.createDataFrame([], schema)
    if before == 0:
        return empty
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(f"{path}/{table}").where(F.col("batch") < before).drop("batch")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty


def keep_clusters(texts: DataFrame, path: str, checkpoint: str, threshold: float = IDENTITY) -> StreamingQuery:
    """Leader clusters of a stream of (doc_id, text), kept up to date in tables under path; see clusters.

    A new sequence meets the leaders before it by the keys that are stored for them, and the other new ones by their own;
    so a batch costs what is new in it and what that meets. However rows in order of doc_id are split into batches, the
    result is that of sequences.leader_clusters, as only leaders can be joined and earlier ones stay what they are. A batch
    that is run again writes the same over what it had written."""
    sequences.check_threshold(threshold)

    def add(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession

        def write(rows: DataFrame, table: str) -> None:
            rows.write.mode("overwrite").parquet(f"{path}/{table}/batch={batch_id}")

        seen = _known(spark, path, "sequences", _SEQUENCES, batch_id).select("token_key", F.col("seq").alias("old")).distinct()
        own = stored(sequences.distinct_sequences(batch).withColumn("token_key", F.xxhash64("tokens")).join(seen, "token_key", "left"), "batch")
        fresh = own.where("old IS NULL").select("seq", "tokens")
        keys = stored(sequences.band_keys(fresh), "keys")
        leaders = _known(spark, path, "leaders", _LEADERS, batch_id)
        pairs = sequences.met_by_keys(keys, keys).unionByName(sequences.met_by_keys(keys, _known(spark, path, "keys", _KEYS, batch_id)))
        links = stored(sequences.identical_enough(pairs, fresh.unionByName(leaders), threshold), "links")
        # leaders from before are not linked to each other, so they lead again
        found = stored(sequences.leaders(fresh.select("seq").unionByName(links.select(F.col("j").alias("seq"))).distinct(), links), "found")
        named = own.join(found, "seq", "left").select("token_key", F.coalesce("old", "seq").alias("seq"), "leader", "copies")
        lead = found.where("seq = leader").select("seq")
        write(fresh.join(lead, "seq", "left_semi"), "leaders")
        write(keys.join(lead, "seq", "left_semi"), "keys")
        write(named, "sequences")

    return texts.select("doc_id", "text").writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(seq, leader, copies) of every different sequence that keep_clusters has seen."""
    rows = spark.read.schema(f"{_SEQUENCES}, batch long").parquet(f"{path}/sequences")
    return rows.groupBy("seq").agg(F.max("leader").alias("leader"), F.sum("copies").alias("copies"))
