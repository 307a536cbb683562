import random

from braidwork.llm.sampling import least_hashes


def test_equals_a_full_ranking(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [(i, rng.choice("aaaab")) for i in range(3000)]
    df = spark.createDataFrame([*rows, (5000, None)], "doc_id long, g string")
    w = Window.partitionBy("g").orderBy(F.xxhash64("doc_id"), "doc_id")
    want = sorted(tuple(r)[:2] for r in df.where("g IS NOT NULL").withColumn("r", F.row_number().over(w)).where("r <= 50").collect())
    got = sorted(tuple(r) for r in least_hashes(df.where("g IS NOT NULL"), "g", "doc_id", 50).select("doc_id", "g").collect())
    assert got == want and len(got) == 100
