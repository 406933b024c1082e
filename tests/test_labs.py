"""Flags of laboratory values: how often a row's text is searched, and odd values."""

from pyspark.sql import functions as F

from tidewell.operators import labs
from tidewell.plans import registry


def test_texts_are_searched_once_a_row(spark):
    """Seven patterns; a nullif may name what it looks at twice."""
    plan = registry.queries()["LAB-06"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert 7 <= plan.count("regexp_extract") <= 14


def test_flags_of_odd_values(spark):
    rows = [
        (">40", "10 - 40", "high"), ("≥ = 1,000", "10-900", "high"), ("40 <", "10 ~ 40", "high"), ("<10", "10 - 40", "low"), ("10>", "10 - 40", "low"), ("<5", "0 - 40", "normal"), ("<0", "0 - 40", "low"), ("", "10 - 40", "unknown"),
        (None, "10 - 40", "unknown"), ("7", "10 - 40", "low"), ("-7", "-10 - 40", "normal"), ("1,041", "10 - 1,040", "high"), ("20", None, "unknown"), ("20", "> 10", "unknown"), ("> 20", "10 - 40", "normal"), ("abc", "1 - 2", "unknown"),
    ]
    found = spark.createDataFrame(rows, "value string, reference string, told string").select("*", labs.flag(F.col("value"), F.col("reference")).alias("flag")).collect()
    assert [x["flag"] for x in found] == [x["told"] for x in found]
