"""How often the ledger's tables are read for a query."""

import pytest

from tidewell.operators import choices
from tidewell.plans import registry


@pytest.mark.parametrize("name", ["FLT-06", "FLT-12", "FLT-02"])
def test_the_ledger_is_joined_once(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2


def test_scopes_of_days(spark):
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, None)], "k int, day string").selectExpr("k", "cast(day as date) as day")
    found = choices.scopes(rows, "day", {"all": None, "late": "2024-01-02"}).select("k", "scope").collect()
    assert sorted(map(tuple, found)) == [(1, "all"), (2, "all"), (2, "late"), (3, "all")]


def test_owners_and_identities_read_the_ledger_once(spark):
    """The join reads what was written of both, not the ledger's tables."""
    plan = registry.queries()["JN-04"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and "orders.parquet" not in plan


@pytest.mark.parametrize("name", ["FLT-12", "TXT-01-buckets"])
def test_lines_are_not_sorted_for_their_orders(spark, name):
    """Whatever the sizes, a task keeps its orders, and lines pass by them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "BuildRight" in plan and "SortMergeJoin" not in plan
