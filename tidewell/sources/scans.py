"""SRC-18: statements with parameters, and tables of a database, read side by side with filters and columns left to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def statement(spark: SparkSession, sql: str, tables: dict[str, DataFrame], **values) -> DataFrame:
    """A statement over tables by name (in braces) with named values (after a colon), which are values and never text."""
    return spark.sql(sql, args=values, **tables)


def database_table(spark: SparkSession, url: str, name: str, key: str, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database in `parts` ranges of a whole-number key, each read by a connection of its own. The ends come from the
    database; rows without a key are in the first range. Filters, columns and sums that the database can work out are left to
    it. An empty table is read by one connection."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    ends = reader.option("query", f"select min({key}) as a, max({key}) as b from {name}").load().first()
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if ends[0] is not None and ends[0] < ends[1]:
        reader = reader.options(partitionColumn=key, lowerBound=str(ends[0]), upperBound=str(ends[1] + 1), numPartitions=str(parts))
    return reader.load()
