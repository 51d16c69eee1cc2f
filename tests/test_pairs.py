"""Pairs of good and bad rows."""

from pyspark.sql import functions as F

from tidemark.operators.training import preference_pairs


def test_pairs_of_one_large_group_are_dealt_out(spark):
    rows = spark.range(400).select(F.lit("a").alias("g"), F.col("id").alias("k"), (F.col("id") % 2).alias("good"))
    more = spark.createDataFrame([("b", None, 1), ("b", 7, 0), ("b", 7, 0), (None, 1, 1), (None, 2, 0), ("c", 1, 1)], "g string, k long, good long")
    pairs = preference_pairs(rows.unionByName(more), "g", "k", F.col("good") == 1, F.col("good") == 0, size=16)
    got = pairs.where("g = 'a'")
    assert got.count() == 40000 == got.where("chosen % 2 = 1 and rejected % 2 = 0").distinct().count()
    assert [tuple(r) for r in pairs.where("g <> 'a'").collect()] == [("b", None, 7)] * 2
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() == 4
