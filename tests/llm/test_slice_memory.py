import tracemalloc

import pyarrow as pa

from braidwork.llm import jaccard


def test_signing_a_batch_of_texts_takes_little_memory_at_a_time():
    texts = pa.array([" ".join(f"w{(r * 7919 + k) % 5000}" for k in range(4000)) for r in range(200)])
    ids = pa.array(range(len(texts)))
    batch = pa.RecordBatch.from_arrays([ids, ids, texts], ["doc_id", "text_key", "text"])
    sign = jaccard._sign(jaccard.SHINGLE, 16)
    alone = [row for k in range(len(batch)) for part in sign(iter([batch.slice(k, 1)])) for row in part.to_pylist()]
    tracemalloc.start()
    parts = list(sign(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [row for part in parts for row in part.to_pylist()] == alone
    assert peak < 40 << 20


def test_batches_of_texts_are_bounded_by_bytes(spark):
    from braidwork.llm import secrets

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        docs = spark.range(300).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 4000) AS text", "'a' AS source").coalesce(1)
        secrets.find_candidates(docs, docs["source"], docs["doc_id"])
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes])}) for b in batches), "n long").collect()
        assert max(r.n for r in sizes) < 5 << 20
        spark.conf.set(key, "8m")
        secrets.find_candidates(docs, docs["source"], docs["doc_id"])
        assert spark.conf.get(key) in ("8m", str(8 << 20))
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
