"""N-gram Jaccard join by chosen paths.

Documents are sets of word n-grams. Documents of equal sets are one member, so copies cost one row. Every run splits
the members by the value of one minimum-hash coordinate: a pair of similarity s meets in a bucket with probability s.
A bucket above LIMIT is split again by two sampled coordinates, until it is small or its members agree on most
coordinates; those dense buckets are compared in blocks, so nothing is capped. Runs are repeated until a pair at the
threshold is found with the target recall.

Buckets are first compared by sketches (the share of equal coordinates); only members with a likely partner are read
again and compared exactly. A pair is counted in the least of the buckets that its members share, and each bucket
returns one row a member, so no list of pairs is formed.

Edge cases: a text of fewer words than n is the set of its one shorter run; a null text, or one without words, has an
empty set, is similar to nothing and is a class of its own; repeated rows are copies of each other; rows with a null
doc_id are compared like all others, but name no class unless all its rows have none; an empty table gives an empty
result; other columns may have any name and are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.blocks import SMALL_SLICE_BYTES, Spans, mix, slices, words
from braidwork.llm.components import components
from braidwork.session import small_batches, stored

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.99999
#: Coordinates for sketches and for splits below the first.
SKETCH = 64
#: Most members of a bucket that is compared at once; share of a bucket in one value that makes it dense.
LIMIT, DENSE = 400, 0.7
_MOST_SPLITS = 24
_ROW_SHIFT, _HASH_MASK = np.uint64(54), np.uint64((1 << 54) - 1)
_ROWS = 1000


def missed(s: float, runs: int, coordinates: int = SKETCH) -> float:
    """Probability that a pair of similarity s meets in no run, if its bucket is split again to the last depth.

    A run finds the pair if they agree on its own coordinate and stay together in at least one child at every further
    split. These draw two of the sampled coordinates, which all runs share: m of them agree (binomial), and given m
    the probability of being lost follows q = (1 - a + a q)^2 with a = m / coordinates."""
    total = 0.0
    for m in range(coordinates + 1):
        a, q = m / coordinates, 0.0
        for _ in range(_MOST_SPLITS):
            q = (1 - a + a * q) ** 2
        total += math.comb(coordinates, m) * s**m * (1 - s) ** (coordinates - m) * (1 - s * (1 - q)) ** runs
    return total


def runs_for(threshold: float, recall: float) -> int:
    """Least number of runs that find a pair at the threshold with the recall, however often its buckets are split."""
    runs = 1
    while missed(threshold, runs) > 1 - recall:
        runs += 1
    return runs


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of at most _ROWS texts, ordered by row."""
    w = words(column)
    hashes, counts = w.hashes(), w.counts
    at, grams = w.grams(hashes, n)
    rows = w.row()[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = Spans(hashes).hashes(w.first[short], w.first[short + 1])
        rows, grams = np.concatenate([rows, short]), np.concatenate([grams, whole])
    keys = np.unique(rows.astype(np.uint64) << _ROW_SHIFT | grams >> np.uint64(10))
    return (keys >> _ROW_SHIFT).astype(np.int64), mix(keys & _HASH_MASK)


def _sign(n: int, coordinates: int):
    salts = mix(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    odd = mix(salts) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SMALL_SLICE_BYTES):
            for k in range(0, part.num_rows, _ROWS):
                batch = part.slice(k, _ROWS)
                rows, hashes = shingle_sets(batch.column("text"), n)
                sizes = np.bincount(rows, minlength=batch.num_rows)
                full = np.flatnonzero(sizes)
                begin = (np.cumsum(sizes) - sizes)[full]
                key = np.zeros(batch.num_rows, np.uint64)
                mins = np.zeros((batch.num_rows, coordinates), np.uint64)
                if len(full):
                    key[full] = mix(np.add.reduceat(mix(hashes), begin) ^ sizes[full].astype(np.uint64))
                    for c in range(coordinates):
                        mins[full, c] = np.minimum.reduceat((hashes ^ salts[c]) * odd[c], begin)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(mins.view(np.int64).ravel()), coordinates).cast(pa.list_(pa.int64()))
                columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(key.view(np.int64)), pa.array(sizes.astype(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "member", "size", "mins"])

    return sign


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of rows that are sorted by key, several at a time."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key).to_numpy(zero_copy_only=False)
        if kept and column[-1] == kept[0].column(key)[0].as_py():
            kept.append(batch)
            continue
        cut = int(np.searchsorted(column, column[-1]))
        if kept or cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
        kept = [batch.slice(cut)]
    if kept:
        yield pa.Table.from_batches(kept)


def _edges(column: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [len(column)]]).tolist()
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _allowed(side: np.ndarray, leaves: list[np.ndarray], here: int) -> np.ndarray:
    """Pairs that this bucket decides: of the two blocks, or of its one, and with no lesser common bucket."""
    ok = (side[:, None] != side[None, :]) | (side[:, None] == 0)
    np.fill_diagonal(ok, False)
    earlier: dict[int, list[int]] = {}
    for i, own in enumerate(leaves):
        for leaf in own[own < here].tolist():
            earlier.setdefault(leaf, []).append(i)
    for members in earlier.values():
        if len(members) > 1:
            ok[np.ix_(members, members)] = False
    return ok


def _likely(least: float):
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of a bucket with a partner there whose sketch is near."""
        for table in _groups(batches, "bucket"):
            bucket = table.column("bucket").to_numpy()
            sketches = _matrix(table.column("mins"))
            leaf, side = table.column("leaf").to_numpy(), table.column("side").to_numpy()
            lists = table.column("leaves").combine_chunks()
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            kept = np.zeros(len(bucket), bool)
            for a, b in _edges(bucket):
                ok = _allowed(side[a:b], [values[ends[i] : ends[i + 1]] for i in range(a, b)], int(leaf[a]))
                if ok.any():
                    same = np.zeros(ok.shape, np.int16)
                    for c in range(sketches.shape[1]):
                        same += sketches[a:b, None, c] == sketches[None, a:b, c]
                    kept[a:b] = (ok & (same >= least * sketches.shape[1])).any(axis=1)
            yield from table.select(["bucket", "leaf", "side", "member"]).filter(pa.array(kept)).to_batches()

    return likely


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _compare(n: int, threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each member of a bucket that has links: how many documents it is linked to by the pairs decided here,
        and the least member that it is joined with here."""
        for table in _groups(batches, "bucket"):
            bucket, member = table.column("bucket").to_numpy(), table.column("member").to_numpy()
            again = np.zeros(len(bucket), bool)  # repeated rows bring a member's text more than once
            again[1:] = (bucket[1:] == bucket[:-1]) & (member[1:] == member[:-1])
            if again.any():
                table = table.filter(pa.array(~again))
                bucket, member = bucket[~again], member[~again]
            leaf, side, copies = (table.column(c).to_numpy() for c in ("leaf", "side", "copies"))
            lists = table.column("leaves").combine_chunks()
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            texts = table.column("text").combine_chunks()
            out: list[tuple[int, int, int]] = []
            for a, b in _edges(bucket):
                ok = _allowed(side[a:b], [values[ends[i] : ends[i + 1]] for i in range(a, b)], int(leaf[a]))
                if not ok.any():
                    continue
                rows, hashes = shingle_sets(texts.slice(a, b - a), n)
                _, ids = np.unique(hashes, return_inverse=True)
                sizes = np.bincount(rows, minlength=b - a)
                begin = np.cumsum(sizes) - sizes
                mark = np.zeros(int(ids.max(initial=0)) + 1, np.int32)
                parent, linked = list(range(b - a)), np.zeros(b - a, np.int64)
                for i in np.flatnonzero(ok.any(axis=1)).tolist():
                    own = ids[begin[i] : begin[i] + sizes[i]]
                    mark[own] = 1
                    common = np.add.reduceat(mark[ids], begin)
                    mark[own] = 0
                    near = np.flatnonzero(ok[i] & (common >= threshold * (sizes[i] + sizes - common) - 1e-9))
                    linked[i] = copies[a:b][near].sum()
                    for j in near[near > i].tolist():
                        x, y = _root(parent, i), _root(parent, j)
                        parent[max(x, y)] = min(x, y)
                least: dict[int, int] = {}
                for i in np.flatnonzero(linked).tolist():
                    r = _root(parent, i)
                    least[r] = min(least.get(r, int(member[a + i])), int(member[a + i]))
                out += [(int(member[a + i]), int(linked[i]), least[_root(parent, i)]) for i in np.flatnonzero(linked).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], ["member", "linked", "joined"])

    return compare


def choose_paths(members: DataFrame, runs: int, coordinates: int, limit: int = LIMIT) -> DataFrame:
    """members: (member, mins). (leaf, member, blocks): the buckets in which the recursive splits end; those of more
    than limit members, which are dense, get that many blocks. Buckets with one member are left out."""
    first = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.xxhash64(r, F.element_at("mins", r + 1)))
    nodes = stored(members.select("member", F.explode(first).alias("node")), "paths")
    leaves = None
    for _ in range(_MOST_SPLITS):
        sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = nodes.join(sizes, "node")
        done = sized.where(F.col("n") <= limit).select(F.col("node").alias("leaf"), "member", F.lit(1).alias("blocks"))
        leaves = done if leaves is None else leaves.unionByName(done)
        large = stored(sizes.where(F.col("n") > limit), "large")
        if large.isEmpty():
            return leaves
        free = coordinates - runs
        one = F.pmod(F.xxhash64("node"), F.lit(free))
        two = F.pmod(one + 1 + F.pmod(F.xxhash64("node", F.lit(1)), F.lit(free - 1)), F.lit(free))
        asked = nodes.join(large, "node").join(members, "member")
        split = asked.select("node", "n", "member", F.explode(F.array(one, two)).alias("c"), "mins")
        split = split.select("node", "n", "member", F.xxhash64("node", "c", F.element_at("mins", (F.col("c") + runs + 1).cast("int"))).alias("child"))
        split = stored(split, "splits")
        children = split.groupBy("node", "n", "child").agg(F.count(F.lit(1)).alias("m"))
        dense = children.groupBy("node", "n").agg(F.max("m").alias("m")).where(F.col("m") >= DENSE * F.col("n")).select("node", F.ceil(F.col("n") / limit).cast("int").alias("blocks"))
        dense = stored(dense, "dense")
        leaves = leaves.unionByName(nodes.join(dense, "node").select(F.col("node").alias("leaf"), "member", "blocks"))
        nodes = stored(split.join(dense, "node", "left_anti").select("member", F.col("child").alias("node")), "paths")
    rest = nodes.join(nodes.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "node")
    return leaves.unionByName(rest.select(F.col("node").alias("leaf"), "member", "blocks"))


def _blocked(leaves: DataFrame) -> DataFrame:
    """(bucket, leaf, side, member): a dense bucket becomes one for each pair of its blocks. Sides 1 and 2 are two
    blocks to compare with each other, side 0 is a block to compare with itself."""
    block = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = leaves.withColumn("block", block).select("leaf", "member", "block", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    return rows.select(F.xxhash64("leaf", low, high).alias("bucket"), "leaf", side.alias("side"), "member")


def similarity_classes(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs: (doc_id, text). Per row: doc_id, class_id (the least doc_id it is connected to by links), copy_of (the
    least doc_id with the same set), n_links (other documents of at least the threshold's similarity), text_key, and
    class_key, which tells classes apart even where ids repeat; it is null for a text without words."""
    small_batches(docs.sparkSession)
    runs = runs_for(threshold, recall)
    coordinates = runs + SKETCH
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    signed = stored(rows.mapInArrow(_sign(n, coordinates), "doc_id long, text_key long, member long, size long, mins array<long>"), "signed")
    filled = signed.where("size > 0")
    members = stored(filled.groupBy("member").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("of"), F.count(F.lit(1)).alias("copies"), F.first("mins").alias("mins")), "members")
    paths = members.select("member", "mins")

    leaves = stored(_blocked(choose_paths(paths, runs, coordinates)), "leaves")
    own = leaves.groupBy("member").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    known = stored(members.join(own, "member"), "known")
    # a sketch is 31 bits of each coordinate that no run has for itself
    sketch = F.transform(F.slice("mins", runs + 1, SKETCH), lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int")).alias("mins")
    by_bucket = leaves.join(known.select("member", sketch, "leaves"), "member").repartition("bucket").sortWithinPartitions("bucket")
    likely = stored(by_bucket.mapInArrow(_likely(threshold / 2), "bucket long, leaf long, side int, member long"), "likely")

    asked = known.join(likely.select("member").distinct(), "member").select("member", "copies", "leaves", F.col("of.doc_id").alias("doc_id"), F.col("of.text_key").alias("text_key"))
    asked = asked.withColumnsRenamed({"doc_id": "of_id", "text_key": "of_key"})
    read = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))).select("member", "copies", "leaves", "text")
    pairs = likely.join(read, "member").repartition("bucket").sortWithinPartitions("bucket", "member")
    links = stored(pairs.mapInArrow(_compare(n, threshold), "member long, linked long, joined long"), "links")

    found = components(links.select(F.col("member").alias("u"), F.col("joined").alias("v")), "joined")
    degrees = links.groupBy("member").agg(F.sum("linked").alias("linked"))
    ids = members.select("member", F.col("of.doc_id").alias("copy_of"), "copies")
    roots = found.join(ids, found.node == ids.member).groupBy("root").agg(F.min("copy_of").alias("class_id"))
    placed = ids.join(found, ids.member == found.node, "left").join(roots, "root", "left").join(degrees, "member", "left")
    placed = placed.select("member", F.coalesce("root", "member").alias("class_key"), F.coalesce("class_id", "copy_of").alias("class_id"), "copy_of", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    both = signed.select("doc_id", "text_key", "member", "size").join(placed, "member", "left")
    alone = F.col("size") == 0
    return both.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        "text_key",
        "class_key",
    )
