"""How often queries read what they are made from."""

import pytest
from oracle import SF
from pyspark.sql import functions as F

from tidewell.plans import registry
from tidewell.sources import workbooks


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_owners_and_customers_share_their_sets(spark):
    """WIN-01: the join of orders and lines is worked out once, before the sets are compared."""
    assert "l_partkey" not in plan(registry.queries()["WIN-01"](spark, SF))


@pytest.mark.parametrize("name", ["SRC-01-workbook", "SRC-04-workbook", "SRC-08"])
def test_workbooks_are_unpacked_once(spark, name):
    """Headers, totals and rows, or four sheets, come from one reading of the files."""
    assert "MapInArrow" not in plan(registry.queries()[name](spark, SF))


def test_workbooks_are_packed_in_as_many_tasks_as_are_asked_for(spark):
    rows = spark.range(400).select(F.concat(F.lit("f"), "id").alias("file"), F.lit(0).alias("sheet"), F.lit("s").alias("sheet_name"), F.lit(1).alias("row_no"), F.array(workbooks.cell(F.col("id"), "number")).alias("cells"))
    assert workbooks.packed(rows).select(F.spark_partition_id()).distinct().count() == 8
