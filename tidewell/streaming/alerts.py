"""Streams: the same operators as on tables, with watermarks where state must end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.streaming.tables import KeyedTable


def error_windows(errors: DataFrame, width: str = "6 minutes", every: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """STM-03: errors of each fingerprint in windows that overlap by a minute; works on streams and tables alike."""
    made = errors.withWatermark("occurred_at", late).groupBy("fingerprint", F.window("occurred_at", width, every)).agg(F.count("*").alias("n"))
    return made.select("fingerprint", F.col("window.start").alias("window_start"), "n")


def start_upserts(stream: DataFrame, path: str, key: list[str], version: str, checkpoint: str, **options):
    """STM-02: keep a table at path in step with a stream of changed rows: of each key the row with the greatest version stays.
    A batch writes the buckets of its keys only (see KeyedTable, which also takes the options)."""
    return KeyedTable(path, tuple(key), version, **options).start(stream, checkpoint)


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that start_upserts has written at path."""
    made = KeyedTable.opened(spark, path)
    return made and made.read(spark)
