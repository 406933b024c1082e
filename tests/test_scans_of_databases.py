"""Statements with parameters, and a table of a database that runs inside the session."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewell.sources import scans


def test_values_are_never_read_as_text(spark):
    rows = spark.createDataFrame([("a' or '1'='1", 1), ("b", 2)], "name string, n int")
    assert [r["n"] for r in scans.statement(spark, "select n from {t} where name = :name", {"t": rows}, name="a' or '1'='1").collect()] == [1]
    assert [r["d"] for r in scans.statement(spark, "select date_sub(:day, :n) as d", {}, day=date(2024, 3, 10), n=10).collect()] == [date(2024, 2, 29)]


def test_a_database_table_is_read_in_ranges_with_filters_left_to_it(spark):
    url = "jdbc:derby:memory:scans;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(1000).selectExpr("id as K", "id % 7 as V", "concat('name', id) as NAME")
    try:
        rows.write.format("jdbc").options(url=url, dbtable="things", **driver).save()
    except Exception as e:
        pytest.skip(f"no database here: {str(e)[:80]}")
    found = scans.database_table(spark, url, "things", "K", 5, **driver)
    assert found.rdd.getNumPartitions() == 5 and found.count() == 1000
    some = found.where("V = 3 and K < 500").select("NAME")
    assert sorted(r[0] for r in some.collect()) == sorted(f"name{k}" for k in range(500) if k % 7 == 3)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "*EqualTo" in plan.replace("[", "[ ").replace("PushedFilters: [ ", "PushedFilters: [") and "LessThan" in plan
    assert found.agg(F.sum("V")).first()[0] == sum(k % 7 for k in range(1000))
