import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from braidwork.llm import divergence
from helpers import rows_of


def _plainly(docs, least_docs=3, ranks=200):
    rows = [("" if d[2] is None else d[2], "" if d[3] is None else d[3], re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in d[1] or ""))) for d in docs]
    out = []
    for lang in {r[0] for r in rows}:
        seen, total, groups = Counter(), Counter(), {}
        for _, source, w in (r for r in rows if r[0] == lang):
            seen.update(set(w))
            total.update(w)
            groups.setdefault(source, Counter()).update(w)
        kept = [t for t in total if seen[t] >= least_docs]

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(total)
        for s in groups:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ordered) if part == "pair" or k < ranks]
    return sorted(out)


def _docs():
    rng = np.random.default_rng(2)
    vocabulary = [f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)] + ["Été", "日本", "été", "ß", "🙂a", "￮x"]
    rows = []
    for i in range(400):
        share = rng.dirichlet(np.full(len(vocabulary), 0.2)) if i % 3 else np.full(len(vocabulary), 1 / len(vocabulary))
        rows.append((i, " ".join(rng.choice(vocabulary, rng.integers(0, 30), p=share)), [None, "en", "de"][i % 3], [None, "a", "b", "c", "ä"][i % 5], 1, "x", 7))
    return rows


def test_as_counted_plainly(frame):
    docs = _docs()
    for ranks in (200, 7):
        got = divergence.audit_sources(frame(docs + docs[:9]), ranks=ranks).collect()
        assert sorted(map(tuple, got)) == _plainly(docs + docs[:9], ranks=ranks)


def test_equal_values_of_different_cells_are_ranked_together(frame):
    # many terms of one count, so ranks end inside a run of equals
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    rows = [(i, " ".join(words), "en", "a", 1, "x", 1) for i in range(3)] + [(9, "wzz " * 50, "en", "b", 1, "x", 1)] + [(10 + i, "wzz", "en", "c", 1, "x", 1) for i in range(3)]
    got = divergence.audit_sources(frame(rows)).collect()
    assert sorted(map(tuple, got)) == _plainly(rows)
    assert max(r["rank"] for r in got if r.part == "term") == 200


def test_edges(frame, odd_texts):
    assert divergence.audit_sources(frame([])).collect() == []
    docs = rows_of(odd_texts) + [(90 + i, t, "en", None, 1, "x", 7) for i, t in enumerate([None, "", "12 34"])] + [(95, "kein", "de", "s", 1, "x", 7), (96, None, "de", "t", 1, "x", 7), (97, "A a", "xx", "one", 1, "x", 7)]
    got = sorted(map(tuple, divergence.audit_sources(frame(docs)).collect()))
    assert got == _plainly(docs)
    assert [r[4] for r in got if r[0] == "de"] == [0, 0] and not [r for r in got if r[0] == "xx"]


def _batch(rows):
    return pa.RecordBatch.from_pydict({"lang": ["" if r[2] is None else r[2] for r in rows], "source": ["" if r[3] is None else r[3] for r in rows], "text": pa.array([r[1] for r in rows], pa.string())})


def test_slices_add_up_to_the_counts_of_all_rows(monkeypatch):
    batch = _batch(_docs())

    def counted():
        rows = [r for b in divergence._counts(iter([batch, batch.slice(0, 50), batch.slice(0, 0)])) for r in b.to_pylist()]
        sums = {}
        for r in rows:
            n, docs = sums.get((r["lang"], r["source"], r["term"]), (0, 0))
            sums[r["lang"], r["source"], r["term"]] = (n + r["n"], docs + r["docs"])
        return len(rows), sums

    rows, whole = counted()
    assert rows == len(whole)
    monkeypatch.setattr(divergence, "COUNTED_BYTES", 200)
    assert counted() == (rows, whole)
    monkeypatch.setattr(divergence, "HELD_BYTES", 2_000)
    more, sums = counted()
    assert more > rows and sums == whole


def test_a_worker_holds_few_words_at_once(spark, frame):
    rng = np.random.default_rng(4)
    vocabulary = np.array([f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}xyz" for k in range(5_000)])
    rows = [(i, " ".join(rng.choice(vocabulary, 1_000)), "en", f"s{i % 5}") for i in range(1_200)]  # 8 MB
    batch = _batch(rows)
    tracemalloc.start()
    base = pa.total_allocated_bytes()
    most = max(pa.total_allocated_bytes() for _ in divergence._counts(iter([batch]))) - base
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak + most < 80 << 20
    divergence.term_counts(frame([]), 3)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_counts_beyond_long_products(spark):
    from pyspark.sql import functions as F

    rows = [(10**12, 3 * 10**12, 10**6), (0, 1, 1), (7, 10**13, 5)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in rows]
