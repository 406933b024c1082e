"""Joins on keys of which both sides have many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block: a block of one side meets a block of the other in one go.
BLOCK = 1024


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of left and right on keys, the pairs of one key dealt over the tasks.

    A key's rows are dealt to blocks of about BLOCK by a hash of the row, on either side, and every block of one side is sent to
    each block of the other: a pair is met once, and no task has more than some blocks of a key however many pairs it has."""
    spark = left.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    cut = blocks(left, "l_blocks_").join(blocks(right, "r_blocks_"), keys)
    at = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    l = left.join(cut, keys).withColumn("l_at_", at(left, "l_blocks_")).withColumn("r_at_", every("r_blocks_")).drop("l_blocks_", "r_blocks_")  # noqa: E741
    r = right.join(cut, keys).withColumn("r_at_", at(right, "r_blocks_")).withColumn("l_at_", every("l_blocks_")).drop("l_blocks_", "r_blocks_")
    met = [*keys, "l_at_", "r_at_"]
    # A number that is asked for, as small partitions would be put together by their bytes, not by their pairs
    return l.repartition(tasks, *met).join(r.repartition(tasks, *met), met).drop("l_at_", "r_at_")
