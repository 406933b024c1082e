"""Joins on keys of many rows on both sides, against plain ones, and how their pairs lie over the tasks."""

from pyspark.sql import functions as F

from tidewell.operators import choices, joins


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_pairs_of_one_key_are_those_of_a_plain_join_and_dealt(spark):
    key = F.when(F.col("id") % 10 == 0, F.col("id") % 7).when(F.col("id") % 10 > 1, 99)
    left = spark.range(6000).select(key.alias("k"), F.col("id").alias("l"))
    right = spark.range(5000).select(key.alias("k"), F.col("id").alias("r"))
    told = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("k", "l", "r") % 1000003)).collect()[0]
    made = joins.dealt_join(left, right, ["k"])
    assert made.columns == ["k", "l", "r"] and told(made) == told(left.join(right, "k"))
    assert largest_share(made) < 0.5


def test_stores_of_one_name_are_dealt(spark):
    targets = spark.range(4000).selectExpr("1 as place", "id as t", "'store 7' as target")
    seen = spark.range(5000).selectExpr("1 as place", "id as s", "'Best store7' as seen")
    made = choices.same_stores(targets, "target", seen, "seen", ["place"])
    assert made.select("t", "s").distinct().count() == made.count() == 20_000_000
    assert largest_share(made.select("t", "s")) < 0.5
