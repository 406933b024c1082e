"""Sources: exports with positions instead of headers, pages' tables as text, and nested payloads; and CSV sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import dates, numbers, text
from tidewell.operators.storage import written

# Positions of a sales export's columns, by chart system: number, name, patient, treatment, amount
POSITIONS = {"woorien": {"service_date": 0, "customer_no": 1, "customer_name": 2, "patient_name": 3, "treatment": 5, "amount": 11}, "efriends": {"service_date": 0, "customer_name": 5, "treatment": 6, "receipt": 7, "amount": 10}}


def raw_rows(spark: SparkSession, path: str, columns: int, encoding: str = "UTF-8") -> DataFrame:
    """SRC-05 and SRC-06: a CSV file's rows as c0, c1, ... with file and row_no (ascends within the file, as Spark numbers the parts of a file in order; not gapless)."""
    schema = ", ".join(f"c{i} string" for i in range(columns))
    rows = spark.read.csv(path, schema=schema, encoding=encoding, quote='"', escape='"')
    return rows.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row_no"))


def export_rows(spark: SparkSession, path: str, columns: int, other: str = "euc_kr") -> DataFrame:
    """SRC-05: raw_rows of files of which each is UTF-8, with or without a byte order mark, or in the other encoding where its bytes
    are not valid UTF-8.  Spark's readers lack that encoding, so lines of such files, and only those, are decoded in Arrow batches.
    What a file is, is a row a file, joined to its lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row_no"))
    plain = written(lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("plain_")))  # a row a file

    @F.pandas_udf("string")
    def decoded(values: pd.Series) -> pd.Series:
        return values.map(lambda b: bytes(b).decode(other, "replace"), na_action="ignore")

    lines = lines.join(plain, "file").withColumn("value", F.coalesce(decoded(F.when(~F.col("plain_"), F.col("value").cast("binary"))), "value"))
    schema = ", ".join(f"c{i} string" for i in range(columns))
    cells = F.from_csv(F.regexp_replace("value", "^\ufeff", ""), schema, {"quote": '"', "escape": '"'})
    return lines.where("trim(value) <> ''").select(cells.alias("r"), "file", "row_no").select("r.*", "file", "row_no")


def without_headers(rows: DataFrame, count: int) -> DataFrame:
    """SRC-01: rows of each file without its first `count` ones; these lie in the file's first part, where row_no has no gaps."""
    first = rows.groupBy("file").agg(F.min("row_no").alias("first_"))
    return rows.join(first, "file").where(F.col("row_no") - F.col("first_") >= count).drop("first_")


def positional(rows: DataFrame, positions: dict[str, int]) -> DataFrame:
    """SRC-01, SRC-04 and SRC-05: named and typed columns of a sales export."""
    named = {n: F.col(f"c{i}") for n, i in positions.items()}
    made = {n: dates.parse_mixed_date(c) if n == "service_date" else numbers.parse_amount(c).alias(n) if n == "amount" else text.normalize_text(c) for n, c in named.items()}
    return rows.select("file", "row_no", *(c.alias(n) for n, c in made.items()))


def without_totals(rows: DataFrame, names: list[str], amounts: list[str]) -> DataFrame:
    """SRC-03: rows of each file without a last row that has no names but an amount."""
    blank = F.lit(True)
    for n in names:
        blank &= F.coalesce(F.trim(n) == "", F.lit(True))
    has = F.coalesce(*(numbers.parse_number(F.col(a)) for a in amounts)).isNotNull()
    last = rows.groupBy("file").agg(F.max("row_no").alias("row_no"))
    totals = rows.where(blank & has).join(last, ["file", "row_no"], "left_semi").select("file", "row_no")
    return rows.join(totals, ["file", "row_no"], "left_anti")


def split_valid(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """SNK-07: rows that pass all checks, and the others with the name of the first check that they fail."""
    failed = F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), name) for name, c in checks.items()))
    marked = rows.withColumn("error_code", failed)
    return marked.where("error_code is null").drop("error_code"), marked.where("error_code is not null")


def dated_lines(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """SRC-07: lines of a CSV file that begin with a date, with its numbers; lines without the first number go."""
    parts = F.split("value", ",")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2},"))
    number = lambda i: F.regexp_extract(F.get(parts, F.lit(i)), r"^\s*(-?\d+)", 1).try_cast("long")
    return rows.select(F.get(parts, F.lit(0)).cast("date").alias("metric_date"), *(number(i).alias(f"value_{i}") for i in range(1, columns + 1))).where("value_1 is not null")


def table_rows(pages: DataFrame, body: str) -> DataFrame:
    """SRC-09: (metric_date, value) of each "YYYY.MM.DD.(weekday) TAB number" in a page's text."""
    # One-letter names of weekdays
    pattern = r"(\d{4}\.\d{2}\.\d{2})\.\([월화수목금토일]\)\t([\d,]+)"
    both = F.arrays_zip(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)).alias("d"), F.regexp_extract_all(body, F.lit(pattern), F.lit(2)).alias("v"))
    rows = pages.select(*[c for c in pages.columns if c != body], F.explode(both).alias("r"))
    return rows.select("*", F.to_date("r.d", "yyyy.MM.dd").alias("metric_date"), F.replace("r.v", F.lit(","), F.lit("")).cast("long").alias("value")).drop("r")


def rank_rows(items: DataFrame, sections: list[str]) -> DataFrame:
    """SRC-14: a row for each section's rank of an item, and one for the best of them if there is any."""
    keys = [c for c in items.columns if c not in sections]
    best = F.least(*map(F.col, sections)) if len(sections) > 1 else F.col(sections[0])
    listed = [F.struct(F.lit(s).alias("section"), F.col(s).alias("rank_value")) for s in sections] + [F.struct(F.lit("best").alias("section"), best.alias("rank_value"))]
    return items.select(*keys, F.inline(F.array(*listed))).where("section <> 'best' or rank_value is not null")


def competitor_rows(items: DataFrame, key: list[str]) -> DataFrame:
    """SRC-15: rows of the slots 1 to 3; of those with one key the first (column seq)."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy("seq"))
    return items.where("slot between 1 and 3").withColumn("n_", first).where("n_ = 1").drop("n_")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SRC-21."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def wide_ranks(ranks: DataFrame, sections: list[str]) -> DataFrame:
    """SNK-09: a column a section, ranks written out, a dash where there is none."""
    shown = lambda s: F.coalesce(F.concat(F.min(F.when(F.col("section") == s, F.col("rank_value"))).cast("string"), F.lit("위")), F.lit("—"))
    return ranks.groupBy("metric_date", "keyword").agg(*(shown(s).alias(s) for s in sections))


def replace_range(rows: DataFrame, path: str, partition: str) -> None:
    """SNK-04: write rows over the partitions that they have; the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def amount_column(header: list[list[str]], fallback: list[int], group: str = "청구금액", name: str = "합계") -> int | None:
    """SRC-02: where the amount stands in an export with two header rows: under the group's name, which holds to its right until
    the next one, the column with the given name; else the first of the fallbacks that the export has."""
    upper, lower = header
    held = ""
    for i, below in enumerate(lower):
        held = (upper[i].strip() if i < len(upper) else "") or held
        if held == group and below.strip() == name:
            return i
    return next((i for i in fallback if i < max(len(upper), len(lower))), None)


def write_marked_csv(rows: DataFrame, path: str) -> None:
    """SNK-10: one CSV file with a byte order mark before its header, for spreadsheets; for tables of a sheet's size."""
    quoted = lambda c: F.when(c.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    lines = rows.select(F.lit(1).alias("o"), F.concat_ws(",", *(quoted(F.col(c).cast("string")) for c in rows.columns)).alias("value"))
    head = rows.sparkSession.createDataFrame([(0, "\ufeff" + ",".join(rows.columns))], "o int, value string")
    head.union(lines).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
