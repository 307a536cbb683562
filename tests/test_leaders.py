"""Near sequences are met without forming the pairs of a common passage, or all pairs of near copies."""

import random

from braidwork.operators import sequences as sq


def _brute(texts: dict[int, list[str]], threshold: float) -> dict[int, int]:
    leads, out = [], {}
    for k in sorted(texts):
        first = next((j for j in leads if sum(x == y for x, y in zip(texts[k], texts[j])) / min(len(texts[k]), len(texts[j])) > threshold), None)
        if first is None:
            leads.append(k)
        out[k] = k if first is None else first
    return out


def _texts() -> dict[int, list[str]]:
    draw, texts = random.Random(5), {}
    head = [f"head{k}" for k in range(10)]
    base = [f"base{k}" for k in range(100)]
    for k in range(30):  # a passage that many share at one place
        texts[2 * k] = head + [f"own{k}.{p}" for p in range(30 + k)]
    for k in range(30):  # copies of one text, changed in up to 6 of 100 places, some cut short
        row = list(base)
        for p in draw.sample(range(100), draw.randrange(7)):
            row[p] = f"new{k}.{p}"
        texts[2 * k + 1] = row[: draw.choice([100, 100, 90, 60])]
    for k, n in enumerate((1, 3, 9, 10, 11)):
        texts[200 + k] = base[:n]
    return texts


def test_leaders_equal_a_scan_in_order(spark):
    texts = _texts()
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    different: dict[tuple, int] = {}
    for k in sorted(texts):
        different.setdefault(tuple(texts[k]), k)
    for threshold in (0.95, 0.97):
        got = {r.seq: r.leader for r in sq.leader_clusters(docs, threshold).collect()}
        assert got == _brute({v: list(k) for k, v in different.items()}, threshold)


def test_common_passages_and_near_copies_make_no_square(spark):
    head = [f"head{k}" for k in range(10)]
    rows = [(k, head + [f"own{k}.{p}" for p in range(30)]) for k in range(60)]
    found = sq.sides(spark.createDataFrame(rows, "seq long, tokens array<string>"), 0.95)
    assert sq.met(found.wanted, found.known).isEmpty()
    copies = [(k, [f"t{p}" if p != k else f"x{k}" for p in range(100)]) for k in range(60)]
    assert sq.leader_links(spark.createDataFrame(copies, "seq long, tokens array<string>"), 0.95).count() < 2 * 60
