from braidwork.streaming import incremental


def test_leaders_of_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "leaders")
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c")], schema).coalesce(1).write.mode("append").parquet(source)
    for k in range(2):
        q = incremental.keep_leaders(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "check"))
        q.awaitTermination()
        spark.createDataFrame([(10 + k, "a b"), (20 + k, f"new {k}")], schema).write.mode("append").parquet(source)
    got = sorted(r.doc_id for r in spark.read.parquet(out).collect())
    assert got == [1, 3, 20]


def test_windows_and_repeats(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("2024-01-01 00:10:00", "a", "x y"), ("2024-01-01 00:20:00", "a", "x  y"), ("2024-01-01 01:10:00", "b", "z")]
    spark.createDataFrame(rows, "ts string, state string, text string").selectExpr("to_timestamp(ts) AS ts", "state", "text").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, state string, text string").parquet(source)
    for name, df, mode in (("counts", incremental.windowed_counts(stream, "ts", "state"), "complete"), ("firsts", incremental.first_of_each(stream, "ts"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((r.state, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]
    assert spark.table("firsts").count() == 2


def test_clusters_do_not_depend_on_how_a_stream_is_split(spark, tmp_path):
    import random

    from braidwork.operators import sequences

    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(40)] for _ in range(6)]
    rows = []
    for k in range(120):
        words = list(base[k % 6])
        for _ in range(rng.randint(0, 3)):
            words[rng.randint(0, 39)] = f"x{rng.randint(0, 3)}"
        rows.append((k, " ".join(words) if k % 11 else " ".join(words[: rng.randint(0, 4)])))
    schema = "doc_id long, text string"
    want = sorted(map(tuple, sequences.leader_clusters(spark.createDataFrame(rows, schema)).select("seq", "leader", "copies").collect()))
    assert len({r[1] for r in want}) < len(want)
    for n, cuts in enumerate(([0, 120], [0, 7, 50, 51, 120])):
        source, out, check = (str(tmp_path / f"{n}{x}") for x in ("in", "out", "check"))
        for a, b in zip(cuts, cuts[1:], strict=False):
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(source)
            incremental.keep_clusters(spark.readStream.schema(schema).parquet(source), out, check).awaitTermination()
        assert sorted(map(tuple, incremental.clusters(spark, out).select("seq", "leader", "copies").collect())) == want
