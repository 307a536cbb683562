"""Language-model scoring by deleted interpolation.

P(w | u v) = l3 c(u v w) / c(u v) + l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1): maximum-likelihood estimates of orders
3 to 0, mixed by weights that depend on how frequent the context is (c(u v), or c(v) where u v was not seen: each count
below SMALL by itself, then powers of two). The weights are learned by expectation-maximisation on held-out counts:
those of a fixed fold of the training documents, from which the token being predicted is deleted (every count less one).
score is the model's probability of the text. deleted_score is that of the model without the token being predicted, where
the text is a training document: its own rare contexts predict it with near certainty in score, so deleted_score is what
can be held against the scores of other documents. The two are equal for held-out documents.

Counts cover all training documents. They are exchanged by blocks of documents, not by tokens. A block sends each of its
distinct words once, and each of its distinct contexts (pairs of words) once with the words that follow it, as sorted
hashes dealt to count groups by range. A group adds the blocks' counts and returns, in the same order, the corpus counts
of what each block asked for. What is shuffled is a few bytes for each distinct key of a block, a frequent word or pair
is sent once a block, and neither vocabulary nor contexts are ever held in one place. Blocks and groups have fixed sizes,
so their numbers grow with the input (a block sends one row to each group it has keys of, so at many TB rows hold few
keys each). Words and contexts are told apart by 64 bits of hash, the words after one context by 32.

Edge cases: a null text is an empty one, whose only token is the end; repeated rows are separate documents, of one block;
a very long text is a block of its own size; without training tokens every word has probability 1 / (V + 1) with V = 0;
an empty table gives an empty result; other columns may have any name and are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.blocks import WORD, mix, slices, words
from braidwork.session import stored

#: Bytes of text of a block, of a count group of contexts, and of one of words.
BLOCK_BYTES, PAIR_BYTES, WORD_BYTES = 8 << 20, 8 << 20, 48 << 20
#: Blocks or groups of a task.
A_TASK = 4
#: Buckets of a context's frequency, and steps of an estimate for each power of two when weights are learned.
BUCKETS, STEPS, SMALL = 40, 2, 8
_END, _BEGIN, _PAD = (np.uint64(x) for x in (0x5EED0E4D0E4D0001, 0x5EED0BE6000B0003, 0x5EED00AD00AD0005))
_PAIR = 1 << 40
_LOW32 = np.uint64(0xFFFFFFFF)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of each value among them."""
    found, at = np.unique(values, return_inverse=True)
    return found, at.astype(np.int32)


class Block:
    """Tokens of some documents (words, then one end for each document), and their distinct words and contexts."""

    def __init__(self, texts: pa.ChunkedArray):
        hashes, counts = [], []
        for batch in slices(pa.table({"text": texts}).to_batches()):
            w = words(batch.column("text"))
            hashes.append(w.hashes(lower=True))
            counts.append(w.counts)
        plain, n = np.concatenate(hashes), np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(n + 1)])
        self.row = np.repeat(np.arange(len(n), dtype=np.int32), n + 1)
        self.tokens = np.full(int(self.first[-1]), _END, np.uint64)
        ends = np.zeros(len(self.tokens), bool)
        ends[self.first[1:] - 1] = True
        self.tokens[~ends] = plain
        # one entry for each token and one more for each document, whose context is its last pair
        begin = self.first[:-1] + np.arange(len(n))
        self.at = np.arange(len(self.tokens), dtype=np.int32) + self.row
        entry = np.full(len(self.tokens) + len(n), _PAD, np.uint64)
        entry[self.at] = self.tokens
        self.words, self.word = _distinct(self.tokens)
        del self.tokens
        pair = np.empty_like(entry)
        pair[2:] = entry[:-2]
        pair[begin] = pair[begin + 1] = _BEGIN
        pair *= np.uint64(0x9E3779B97F4A7C15)
        pair[1:] ^= entry[:-1]
        pair[begin] = _BEGIN
        self.contexts, self.context = _distinct(mix(pair))
        entry >>= np.uint64(32)
        entry |= self.context.astype(np.uint64) << np.uint64(32)
        del pair
        self.follows, self.follow = _distinct(entry)
        self.entry_row = np.insert(self.row, self.first[1:], np.arange(len(n), dtype=np.int32))

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each distinct word, and each distinct continuation, occurs in the block's training documents."""
        one = np.bincount(self.word, train[self.row], minlength=len(self.words))
        return one.astype(np.int64), np.bincount(self.follow, train[self.entry_row], minlength=len(self.follows)).astype(np.int64)


def pack_counts(counts: np.ndarray) -> bytes:
    """One byte a count, those from 255 on in 8 more bytes each; compressed, as most counts are small."""
    plain = np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()
    return len(plain).to_bytes(4, "little") + pa.compress(plain, "zstd", asbytes=True)


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    plain = pa.decompress(data[4:], int.from_bytes(data[:4], "little"), "zstd", asbytes=True)
    counts = np.frombuffer(plain, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(plain, "<u8", offset=n)
    return counts


def pack_sorted(keys: np.ndarray, bits: int) -> bytes:
    """Sorted numbers of so many bits: their low bytes, and the rest as one bit a number and one a step."""
    n = len(keys)
    size = {k: n * k + (n + (1 << max(bits - 8 * k, 0)) + 7) // 8 for k in range(max(bits - 24, 0) // 8, (bits + 7) // 8 + 1)}
    k = min(size, key=size.get)
    high = (keys >> np.uint64(8 * k)).astype(np.int64) if k < 8 else np.zeros(n, np.int64)
    marks = np.zeros(n + int(high[-1]) + 1 if n else 0, np.uint8)
    marks[high + np.arange(n)] = 1
    low = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k])
    return bytes([k]) + low.tobytes() + np.packbits(marks).tobytes()


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    k = data[0]
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :k] = np.frombuffer(data, np.uint8, n * k, 1).reshape(n, k)
    low = wide.view("<u8").ravel().astype(np.uint64)
    if k == 8:
        return low
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1 + n * k)))[:n] - np.arange(n)
    return low | high.astype(np.uint64) << np.uint64(8 * k)


@dataclass(frozen=True)
class Groups:
    """Count groups: ranges of hashes of equal width."""

    n: int

    @property
    def width(self) -> int:
        return (1 << 64) // self.n

    @property
    def bits(self) -> int:
        return ((1 << 64) - 1 - (self.n - 1) * self.width).bit_length()

    def low(self, g) -> np.ndarray:
        return np.asarray(g, np.uint64) * np.uint64(self.width) if self.n > 1 else np.zeros_like(np.asarray(g, np.uint64))

    def cuts(self, keys: np.ndarray) -> list[tuple[int, int, int]]:
        """(group, begin, end) of the groups that sorted keys fall into."""
        edges = np.append(np.searchsorted(keys, self.low(np.arange(self.n))), len(keys))
        some = np.flatnonzero(np.diff(edges))
        return list(zip(some.tolist(), edges[some].tolist(), edges[some + 1].tolist(), strict=True))


_MESSAGE = "group long, block long, n int, keys binary, follow binary, next binary, counts binary"


def _ask(word_groups: Groups, pair_groups: Groups):
    def ask(table: pa.Table) -> pa.Table:
        """Distinct words and contexts of a block by count group, with their counts in its training documents."""
        block = Block(table.column("text"))
        one, three = block.counts(table.column("train").to_numpy())
        number, out = table.column("block")[0].as_py(), []
        for g, a, b in word_groups.cuts(block.words):
            out.append((g, number, b - a, pack_sorted(block.words[a:b] - word_groups.low(g), word_groups.bits), b"", b"", pack_counts(one[a:b])))
        first = np.searchsorted(block.follows >> np.uint64(32), np.arange(len(block.contexts) + 1))
        size, nexts = np.diff(first), (block.follows & _LOW32).astype("<u4")
        for g, a, b in pair_groups.cuts(block.contexts):
            x, y = first[a], first[b]
            out.append((_PAIR + g, number, b - a, pack_sorted(block.contexts[a:b] - pair_groups.low(g), pair_groups.bits), pack_counts(size[a:b]), nexts[x:y].tobytes(), pack_counts(three[x:y])))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], ["group", "block", "n", "keys", "follow", "next", "counts"])

    return ask


def _parts(values: np.ndarray, sizes: list[int]) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [pack_counts(values[e - m : e]) for e, m in zip(ends, sizes, strict=True)]


def _answer(table: pa.Table) -> pa.Table:
    """Corpus counts of one group's keys for each block: of words, or of contexts and, as more, of what follows them.
    Block -1 gets how many words of the group have a count."""
    group, n = table.column("group")[0].as_py(), table.column("n").to_pylist()
    keys = np.concatenate([unpack_sorted(k, m) for k, m in zip(table.column("keys").to_pylist(), n, strict=True)])
    _, inverse = np.unique(keys, return_inverse=True)
    block, counts = table.column("block").to_pylist(), table.column("counts").to_pylist()
    if group < _PAIR:
        total = np.bincount(inverse, np.concatenate([unpack_counts(c, m) for c, m in zip(counts, n, strict=True)])).astype(np.int64)
        block, answers = [*block, -1], [*_parts(total[inverse], n), pack_counts(np.array([(total > 0).sum()]))]
        more = [b""] * len(block)
    else:
        follow = np.concatenate([unpack_counts(c, m) for c, m in zip(table.column("follow").to_pylist(), n, strict=True)])
        nexts = [np.frombuffer(x, "<u4") for x in table.column("next").to_pylist()]
        sizes = [len(x) for x in nexts]
        of = np.repeat(inverse, follow)
        count = np.concatenate([unpack_counts(c, m) for c, m in zip(counts, sizes, strict=True)])
        _, same = np.unique(of.astype(np.uint64) << np.uint64(32) | np.concatenate(nexts), return_inverse=True)
        answers = _parts(np.bincount(of, count).astype(np.int64)[inverse], n)
        more = _parts(np.bincount(same, count).astype(np.int64)[same], sizes)
    return pa.Table.from_arrays([pa.array([group] * len(block), pa.int64()), pa.array(block, pa.int64()), pa.array(answers, pa.binary()), pa.array(more, pa.binary())], ["group", "block", "counts", "more"])


class Counts:
    """Corpus counts of a block's tokens: of the token itself, and (count, count of the context) of orders 3 to 1."""

    def __init__(self, block: Block, answers: pa.Table, word_groups: Groups, pair_groups: Groups, documents: int, total: int):
        by_group = {g: (c, m) for g, c, m in zip(*(answers.column(k).to_pylist() for k in ("group", "counts", "more")), strict=True)}
        one = np.concatenate([unpack_counts(by_group[g][0], b - a) for g, a, b in word_groups.cuts(block.words)])[block.word]
        first = np.searchsorted(block.follows >> np.uint64(32), np.arange(len(block.contexts) + 1))
        cuts = pair_groups.cuts(block.contexts)
        context = np.concatenate([unpack_counts(by_group[_PAIR + g][0], b - a) for g, a, b in cuts])[block.context]
        three = np.concatenate([unpack_counts(by_group[_PAIR + g][1], int(first[b] - first[a])) for g, a, b in cuts])[block.follow[block.at]]
        before = np.empty_like(one)
        before[1:] = one[:-1]
        before[block.first[:-1]] = documents
        self.row, self.one = block.row, one
        # a pair occurs as often as it is the context of what follows, the end included
        self.orders = [(three, context[block.at]), (context[block.at + 1], before), (one, np.full(len(one), total))]

    def less(self, deleted: np.ndarray) -> np.ndarray:
        """By how much each token's counts are lowered: by one in the documents that are predicted without the token."""
        return deleted[self.row].astype(np.int64)

    def bucket(self, less: np.ndarray) -> np.ndarray:
        long = self.orders[0][1] - less
        return np.where(long > 0, bucket_of(long), BUCKETS + bucket_of(self.orders[1][1] - less))

    def estimate(self, order: int, less: np.ndarray) -> np.ndarray:
        """Maximum-likelihood estimates of order 3 - order; 0 where the context was not seen."""
        c, h = self.orders[order]
        return np.where(h > less, np.minimum((c - less) / np.maximum(h - less, 1), 1.0), 0.0)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Counts below SMALL have buckets of their own, as a context seen once tells much less than one seen twice."""
    context = np.maximum(context, 0)
    return np.where(context < SMALL, context, np.minimum(SMALL + np.frexp(context / SMALL)[1] - 1, BUCKETS - 1)).astype(np.int64)


def _cells(bucket: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Bucket and binned estimates, as shares of that of order 0, in one number."""
    bins = np.where(ratio > 0, np.clip(np.rint(STEPS * np.log2(np.maximum(ratio, 1e-30))).astype(np.int64) + 1000, 1, 4095), 0)
    return bucket.astype(np.int64) << 36 | bins[:, 0] << 24 | bins[:, 1] << 12 | bins[:, 2]


def _from_cells(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bins = np.stack([cells >> s & 4095 for s in (24, 12, 0)], axis=1)
    return cells >> 36, np.where(bins > 0, 2.0 ** ((bins - 1000) / STEPS), 0.0)


def learn_weights(bucket: np.ndarray, ratio: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """(bucket, orders) mixture weights by expectation-maximisation over a table of held-out counts: n tokens of a bucket
    whose estimates are ratio times that of order 0, the last order. Buckets without tokens, and every bucket a little,
    follow the weights of all buckets together."""
    likely = np.concatenate([ratio, np.ones((len(ratio), 1))], axis=1)
    orders = likely.shape[1]

    def climb(group: np.ndarray, groups: int, prior: np.ndarray | None) -> np.ndarray:
        start = np.tile(np.full(orders, 1 / orders) if prior is None else prior, (groups, 1))
        w = start.copy()
        for _ in range(rounds):
            part = w[group] * likely
            part *= (n / part.sum(axis=1))[:, None]
            mass = np.stack([np.bincount(group, part[:, k], minlength=groups) for k in range(orders)], axis=1) + start
            w = mass / mass.sum(axis=1, keepdims=True)
        return w

    everything = climb(np.zeros(len(n), np.int64), 1, None)[0]
    return climb(bucket, 2 * BUCKETS, everything)


def score_documents(docs: DataFrame, held_out: Column, delete_fold: Column) -> DataFrame:
    """docs: (doc_id, text). Learns from the rows that held_out does not mark, with weights from those of them that
    delete_fold marks. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and deleted_score of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(delete_fold, F.lit(False)).alias("fold"))
    rows = rows.withColumn("train", ~F.col("held_out")).withColumn("fold", F.col("fold") & F.col("train"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_if("train").alias("documents"), F.coalesce(F.sum(F.when(F.col("train"), F.regexp_count("text", F.lit(WORD)) + 1)), F.lit(0)).alias("tokens")).first()
    total, documents, tokens_total = size["bytes"], size["documents"], int(size["tokens"])
    n_blocks, n_folds = -(-total // BLOCK_BYTES) or 1, -(-total // (10 * BLOCK_BYTES)) or 1
    word_groups, pair_groups = Groups(-(-total // WORD_BYTES) or 1), Groups(-(-total // PAIR_BYTES) or 1)
    key = F.xxhash64("doc_id", "text")
    # the documents that the weights are learned from have blocks of their own, from n_blocks on
    block = F.when(F.col("fold"), n_blocks + F.pmod(key, F.lit(n_folds))).otherwise(F.pmod(key, F.lit(n_blocks)))
    rows = rows.withColumn("block", block.cast("long"))

    def by_block(df: DataFrame, blocks: int):
        return df.repartition(-(-blocks // A_TASK), "block").groupBy("block")

    asked = by_block(rows.select("block", "text", "train"), n_blocks + n_folds).applyInArrow(_ask(word_groups, pair_groups), _MESSAGE)
    grouped = asked.repartition(-(-(word_groups.n + pair_groups.n) // A_TASK), "group").groupBy("group")
    answers = stored(grouped.applyInArrow(_answer, "group long, block long, counts binary, more binary"), "counts")
    # one number for each group of words
    own = answers.where("block = -1").select("counts")
    vocabulary = sum(int(unpack_counts(bytes(r["counts"]), 1)[0]) for r in own.toLocalIterator())
    flat = 1.0 / (vocabulary + 1)

    def held_out_counts(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        b = Block(left.column("text"))
        found = Counts(b, right, word_groups, pair_groups, documents, tokens_total)
        less = found.less(np.ones(left.num_rows, bool))
        ratio = np.stack([found.estimate(k, less) / flat for k in range(3)], axis=1)
        cells, n = np.unique(_cells(found.bucket(less), ratio), return_counts=True)
        return pa.table({"cell": cells, "n": n.astype(np.int64)})

    fold_docs = by_block(rows.where("fold").select("block", "text"), n_folds)
    cells = fold_docs.cogroup(by_block(answers.where(F.col("block") >= n_blocks), n_folds)).applyInArrow(held_out_counts, "cell long, n long")
    # at most the buckets times the binned estimates: a table of bounded size, whatever the input
    table = cells.groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toPandas()
    weights = learn_weights(*_from_cells(table["cell"].to_numpy(np.int64)), table["n"].to_numpy(float))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "deleted_score"]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names)
        b = Block(left.column("text"))
        held = left.column("held_out").to_numpy()
        found = Counts(b, right, word_groups, pair_groups, documents, tokens_total)
        base = np.log10((found.one + 0.1) / (tokens_total + 0.1 * (vocabulary + 1)))

        def per_row(x):
            return np.add.reduceat(x, b.first[:-1])

        def model(deleted):
            less = found.less(deleted)
            bucket = found.bucket(less)
            p = weights[bucket, 3] * flat
            for k in range(3):
                p += weights[bucket, k] * found.estimate(k, less)
            return per_row(np.log10(p))

        columns = [np.diff(b.first), per_row((found.one > 0).astype(np.int64)), np.full(left.num_rows, tokens_total), per_row(base), model(np.zeros(len(held), bool)), model(~held)]
        return pa.Table.from_arrays([left.column("doc_id"), left.column("held_out"), *[pa.array(c, t) for c, t in zip(columns, types[2:], strict=True)]], names)

    texts = by_block(rows.select("block", "doc_id", "held_out", "text"), n_blocks + n_folds)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, deleted_score double"
    return texts.cogroup(by_block(answers.where("block >= 0"), n_blocks + n_folds)).applyInArrow(score, schema)
