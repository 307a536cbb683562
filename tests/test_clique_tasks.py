from pyspark.sql import functions as F

from braidwork.operators import graphs


def test_neighbourhoods_are_dealt_over_tasks(spark):
    links = spark.range(400).select(F.col("id").alias("a"), F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("b"))
    found = graphs.maximal_cliques(links)
    assert found.count() == 399
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 8
