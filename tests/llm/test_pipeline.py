import hashlib
import re

import corpus_pipeline as pipeline

W = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen, frames = docs.columns, [docs.count()], [docs]
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns and docs.schema["doc_id"].dataType == frames[0].schema["doc_id"].dataType
        frames.append(docs)
        seen.append(docs.count())
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    kept = {r.doc_id for r in frames[1].select("doc_id").collect()}
    assert len(toxic & kept) < len(toxic) and seen[1] < seen[0]
    # one of each group: no two kept texts are near copies
    sets = [set(zip(*[w[k:] for k in range(5)], strict=False)) for w in (W.findall(r.text or "") for r in frames[2].collect())]
    assert not any(a and b and len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert seen[3] == seen[2]
    # the mix repeats or drops whole documents, each at most twice
    counts = frames[4].groupBy("doc_id").count().collect()
    assert max(r["count"] for r in counts) <= 2
    out = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(out) == seen[4]
    assert {hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()} == {r.decoded_sha256 for r in out}


def test_run_is_repeatable(spark, sf_dir):
    a, b = (pipeline.run(spark, sf_dir) for _ in range(2))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_odd_rows(spark, frame, sf_dir, odd_texts):
    rows = [(i, t, None, None, None) for i, t in enumerate(odd_texts)] + [(None, "a b c", "en", "s", 5), (0, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, sf_dir), "test")
    # nothing is removed but copies, and texts without words leave in the mix only
    worded = {t for t in odd_texts if t and W.search(t)} | {"a b c"}
    assert docs.count() >= len(worded) - 1


def _stage(name):
    return dict(pipeline.STAGES)[name]


def test_equal_ids_and_clashing_columns(spark, sf_dir):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    names = ["text_key", "class_key", "row", "toxic", "severity", "expected_severity", "copies", "kept", "own", "cuts", "first_id", "id", "worded", "Size", "draw", "bucket"]
    rows = [(7, a, "en", "s", 5, *names), (7, b, "en", "s", 5, *names), (7, b, "en", "s", 5, *names), (9, a, "fr", "t", 5, *names), (None, b + " tail", "en", "s", 5, *names), (None, None, None, None, None, *names), (3, "", "en", "s", 0, *names)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema == docs.schema or [f.simpleString() for f in out.schema] == [f.simpleString() for f in docs.schema]
        kept[name] = out.collect()
        assert all(tuple(r[n] for n in names) == tuple(names) for r in kept[name])
    assert len(kept["toxicity"]) == len(kept["secrets"]) == len(rows)
    assert sorted((str(r.doc_id), r.text) for r in kept["ngram_jaccard"] if r.text) == [("7", a), ("7", b)]
    assert len(kept["ngram_jaccard"]) == 4
    assert all(r.text for r in kept["mix"])


def test_an_empty_table_stays_empty(spark, frame, sf_dir):
    docs = frame([])
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.collect() == []
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).collect() == []


def test_dedup_keeps_the_least_of_each_class(spark, frame, sf_dir):
    rng = __import__("random").Random(4)
    base = [[f"w{rng.randint(0, 300)}" for _ in range(120)] for _ in range(12)]
    rows = []
    for k in range(60):
        words = list(base[k % 12])
        if k >= 24:
            words[rng.randint(0, 119)] = f"x{k}"
        rows.append((1000 - k, " ".join(words), "en", "s", 1, "x", 1))
    sets = {r[0]: set(zip(*[r[1].split()[j:] for j in range(5)], strict=False)) for r in rows}
    seen, best = set(), set()
    for i in sorted(sets):
        if i in seen:
            continue
        best.add(i)
        todo = [i]
        while todo:
            x = todo.pop()
            seen.add(x)
            todo += [y for y in sets if y not in seen and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    assert {r.doc_id for r in _stage("ngram_jaccard")(spark, frame(rows), sf_dir).collect()} == best


def test_further_columns_of_types_without_order(spark, sf_dir):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(k % 3, text if k < 4 else f"{text} other words {k}" * 3, "en", "s", 5, {"k": k}, [{"m": k}], (1.5, {"z": k}), bytearray(b"x")) for k in range(8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, m map<string,int>, a array<map<string,int>>, s struct<f:double,g:map<string,int>>, b binary"
    docs = spark.createDataFrame(rows, schema)
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert [f.simpleString() for f in out.schema] == [f.simpleString() for f in docs.schema]
        kept[name] = out.collect()
        known = {repr(tuple(r)[5:]) for r in docs.collect()}
        assert {repr(tuple(r)[5:]) for r in kept[name]} <= known
        assert sorted(map(repr, stage(spark, docs, sf_dir).collect())) == sorted(map(repr, kept[name]))
    assert len(kept["toxicity"]) == len(kept["secrets"]) == 8
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 8
