import hashlib
import math
import re
import zlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from braidwork.llm import crc, resampling
from helpers import rows_of


@given(st.lists(st.binary(min_size=0, max_size=300), min_size=1, max_size=20))
def test_crcs_of_spans(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts])
    start = end - [len(p) for p in parts]
    assert crc.span_crcs(data, start, end).tolist() == [zlib.crc32(p) for p in parts]


def test_crcs_of_long_and_overlapping_spans():
    data = np.random.default_rng(1).integers(0, 256, 300_000).astype(np.uint8)
    start, end = np.array([0, 5, 5, 100, 0, 299_990]), np.array([300_000, 69, 70, 100_101, 64, 300_000])
    assert crc.span_crcs(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
    assert crc.length_constants(np.array([0, 1, 64, 1_000_000])).tolist() == [zlib.crc32(bytes(n)) for n in (0, 1, 64, 1_000_000)]


def _plainly(docs, target, longest, buckets, seed, percent, least):
    def features(text):
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts([d[1] for d in docs]), counts(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for d in docs:
        n, f = features(d[1])
        h = int(hashlib.sha256(f"{seed}:{d[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        rows.append([d[0], len(f), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[2] >= least), key=lambda r: (-r[4], r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted((*r, rank.get(r[0])) for r in rows)


def test_resampling_as_plainly_counted(spark, frame, odd_texts):
    rng = np.random.default_rng(5)
    texts = odd_texts + [" ".join(rng.choice(["Alpha", "beta", "x1", "été", "b-c", "7"], rng.integers(0, 60))) for _ in range(300)] + ["same text " * 15] * 30
    docs, target = rows_of(texts), ["beta x1 beta " * 20, None, ""]
    for longest, percent in ((1, 10), (3, 35)):
        want = _plainly(docs, target, longest, 997, 2024, percent, 20)
        got = resampling.resample(frame(docs), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=997, percent=percent)
        assert sorted(map(tuple, got.collect())) == want


def test_ranks_of_ties_and_wide_scores(spark):
    rows = [(i, 20, 20, 0, s) for i, s in enumerate([5] * 40 + [-100_000, 99_999, 5_000, 5_000] + [1024, 1023, -1, 0])]
    scored = spark.createDataFrame(rows, "doc_id long, n_features long, n_words long, weight long, score long")
    got = {r.doc_id: r["rank"] for r in resampling.drawn(scored, 50, 20).collect()}
    order = sorted(rows, key=lambda r: (-r[4], r[0]))
    assert got == {r[0]: k + 1 if k < 24 else None for k, r in enumerate(order)}


def test_edges(spark, frame):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(frame([]), target).collect() == []
    docs = rows_of(["word " * 25] * 20) + [(None, "word " * 30, "en", "s", 1, "x", 7)]
    got = resampling.resample(frame(docs + docs[:1]), target.where("false"), percent=50).collect()
    assert len(got) == 22 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 12))
