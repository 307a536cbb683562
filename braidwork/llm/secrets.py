"""Secret scans with corpus-wide ownership frequency.

Candidates are found in every text, hashed, and counted over the corpus by distinct repositories and owners. A value
that several owners share is a widely copied example; one that a single owner has is owner-specific and looks live.

Kinds. Base spans, always reported: assign, access, hex. Added spans, kind live: long mixed tokens outside every base
span whose value a single owner has.

Edge cases: a null text has no span; a null owner or repository counts as one owner or repository of its own; repeated
rows count once for ownership and give equal result rows; spans of equal start are ordered by kind as listed; a very
long text is read whole, by itself; an empty table gives an empty result; other columns may have any name and are
ignored, or kept by redacted().
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.blocks import SMALL_SLICE_BYTES, slices
from braidwork.session import small_batches, stored

KINDS = ("assign", "access", "hex", "live")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MIXED = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: A value that so many owners have is an example.
EXAMPLE_OWNERS = 3
#: Bits a character that a mixed token needs.
LIVE_BITS = 3.5


def bits_per_character(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) in code points. Minimum lengths that can't change which matches are found stand in
    the pattern; the assigned value's is checked after matching, as a short match still uses up its text."""
    found = [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    base = sorted((s, e) for _, s, e, _ in found)
    for m in _MIXED.finditer(text):
        v, s, e = m[0], m.start(), m.end()
        mixed = any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v)
        if mixed and bits_per_character(v) >= LIVE_BITS and not any(a < e and s < b for a, b in base):
            found.append((3, s, e, v))
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=SMALL_SLICE_BYTES):
        rows, found = [], []
        for r, text in enumerate(batch.column("text").to_pylist()):
            for c in candidates(text) if text else ():
                rows.append(r)
                found.append(c)
        take = pa.array(rows, pa.int64())
        kept = [batch.column(n).take(take) for n in ("doc_id", "text_key", "owner", "repo")]
        columns = [pa.array([f[k] for f in found], t) for k, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.int32()), (3, pa.string()))]
        yield pa.RecordBatch.from_arrays([*kept, *columns], ["doc_id", "text_key", "owner", "repo", "kind", "start", "end", "value"])


def find_candidates(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """One row per candidate span; text_key tells rows of one doc_id with different texts apart."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), "text")
    schema = "doc_id long, text_key long, owner string, repo string, kind int, start int, end int, value string"
    return rows.mapInArrow(_scan, schema).withColumn("value", F.sha2("value", 256))


def ownership(found: DataFrame) -> DataFrame:
    """value, n_repos, n_owners: distinct repositories and owners of each candidate hash, over the whole corpus.

    Repeated (value, owner, repo) fall away first, dealt by all three, and what is left is counted by owner before it
    meets by value; so a value that a third of all rows hold is spread over the tasks."""
    pairs = found.select("value", "owner", "repo").distinct()
    owners = pairs.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    return owners.groupBy("value").agg(F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def judged_candidates(docs: DataFrame, owner: Column, repo: Column, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Candidates with n_repos, n_owners and verdict: example, live (one owner) or shared. Mixed tokens only if live."""
    found = stored(find_candidates(docs, owner, repo), "candidates")
    verdict = F.when(F.col("n_owners") >= example_owners, "example").when(F.col("n_owners") == 1, "live").otherwise("shared")
    # written, so that the join can split the rows of a hot value among tasks
    return found.join(stored(ownership(found), "ownership"), "value").withColumn("verdict", verdict).where((F.col("kind") < 3) | (F.col("verdict") == "live"))


def joined_spans(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, owner: Column, repo: Column, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """docs: (doc_id, text and what owner and repo name). One row per row of docs: doc_id, n_assign, n_access, n_hex,
    n_live_added, n_example, n_owner_specific, base_sha256, spans."""
    judged = judged_candidates(docs, owner, repo, example_owners)
    per_doc = stored(judged.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end", "verdict"))).alias("found")), "spans")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"))
    d = per_doc.select(F.col("doc_id").alias("d_id"), F.col("text_key").alias("d_key"), "found")
    both = rows.join(d, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("text_key") == F.col("d_key")), "left")
    none = F.from_json(F.lit("[]"), "array<struct<start:int,kind:int,end:int,verdict:string>>")
    both = both.withColumn("found", F.coalesce("found", none))

    def count(test):
        return F.size(F.filter("found", test)).cast("long")

    def of_kind(k):
        return lambda s: s["kind"] == k

    return both.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[count(of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)],
        count(of_kind(3)).alias("n_live_added"),
        count(lambda s: s["verdict"] == "example").alias("n_example"),
        count(lambda s: s["verdict"] == "live").alias("n_owner_specific"),
        F.sha2(joined_spans(F.filter("found", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        joined_spans(F.col("found")).alias("spans"),
    )


def redacted(docs: DataFrame, owner: Column, repo: Column, mark: str = "[secret]", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """docs with every span that is not a widely copied example replaced by mark; other rows and columns unchanged.

    Overlapping spans are replaced as one."""
    judged = judged_candidates(docs, owner, repo, example_owners).where("verdict <> 'example'")
    cuts = judged.groupBy(F.col("doc_id").alias("cut_id"), F.col("text_key").alias("cut_key")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    # written, so that its size is known: where it is small, no text is shuffled
    cuts = stored(cuts, "cuts")
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64("text").alias("text_key"))
    both = keyed.join(cuts, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("text_key") == F.col("cut_key")), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    merged = F.aggregate(
        "cuts",
        start,
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    row = F.when(F.col("cuts").isNull(), F.col("row")).otherwise(F.col("row").withField("text", merged))
    return both.select(row.alias("row")).select("row.*")
