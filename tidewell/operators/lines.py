"""Ordered lines of documents: sections, groups by date, plans and islands.  Rows have doc_id, line_no and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _so_far(*keys: str):
    return Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def sections(lines: DataFrame, header: Column, default: str, *keys: str) -> DataFrame:
    """TXT-01 and WIN-15: each line with the section of the last header at or before it (header: a section's name, or null)."""
    return lines.withColumn("section", F.coalesce(F.last(header, ignorenulls=True).over(_so_far(*keys)), F.lit(default)))


def date_groups(lines: DataFrame, key: Column, *keys: str) -> DataFrame:
    """TXT-02: lines by the date of the last header before them; headers themselves go, lines before the first are
    'unknown', and a date that comes again joins its earlier lines."""
    made = lines.withColumn("header_", key)
    return made.withColumn("group_key", F.coalesce(F.last("header_", ignorenulls=True).over(_so_far(*keys)), F.lit("unknown"))).where("header_ is null").drop("header_")


def visits(lines: DataFrame, key: Column, *keys: str) -> DataFrame:
    """TXT-02: like date_groups, but each header opens a group of its own; the n-th of one date ends in " (n)"."""
    named = lines.withColumn("header_", key)
    n = F.row_number().over(Window.partitionBy(*keys, "header_").orderBy("line_no"))
    named = named.withColumn("name_", F.when(F.col("header_").isNotNull(), F.when(n > 1, F.concat(F.col("header_"), F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col("header_"))))
    return named.withColumn("group_key", F.coalesce(F.last("name_", ignorenulls=True).over(_so_far(*keys)), F.lit("unknown"))).where("header_ is null").drop("header_", "name_")


def with_next(lines: DataFrame, *keys: str) -> DataFrame:
    """WIN-16: each line with the next two."""
    order = Window.partitionBy(*keys).orderBy("line_no")
    return lines.withColumns({"next_1": F.lead("text", 1).over(order), "next_2": F.lead("text", 2).over(order)})


def body_and_plan(lines: DataFrame, is_plan: Column, *keys: str) -> DataFrame:
    """TXT-03: texts of the lines before the first plan header, and of those after it."""
    made = lines.withColumn("plan_", is_plan).withColumn("start_", F.min(F.when(F.col("plan_"), F.col("line_no"))).over(Window.partitionBy(*keys)))
    joined = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("line_no", "text")))), lambda x: x["text"]), "\n")
    before = F.col("start_").isNull() | (F.col("line_no") < F.col("start_"))
    return made.groupBy(*keys).agg(joined(before).alias("body_text"), joined(F.col("line_no") > F.col("start_")).alias("plan_text"), F.max(F.col("start_").isNotNull()).alias("plan_detected"))


def islands(lines: DataFrame, inside: Column, *keys: str) -> DataFrame:
    """TXT-09: first and last lines of runs of neighbouring lines for which `inside` holds."""
    kept = lines.where(inside)
    run = F.col("line_no") - F.row_number().over(Window.partitionBy(*keys).orderBy("line_no"))
    return kept.withColumn("run_", run).groupBy(*keys, "run_").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n_lines")).drop("run_")
