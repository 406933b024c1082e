"""Running sums and last values along an order, for keys of any size.

A window over a key puts all of its rows in one task. Here the rows are cut into ordered spans, each a small share of all rows;
each span is reduced to a row (its sums, its last values), a window over a key's spans tells what comes before each, and that
is added to what a window within the span finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.storage import written


def spans(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """rows with span_: numbers of ranges of (keys, order), ascending within a key. There are `parts` ranges (by default
    spark.sql.shuffle.partitions) of near equal size, so the spans of a key are as many as its share of the rows asks for; rows
    that are equal in keys and order share a span. The rows are written once, as ranges come from a sample."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(parts, *keys, *order).withColumn("span_", F.spark_partition_id()))


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, str] | None = None, lows: dict[str, str] | None = None, lasts: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """rows with, by their names: of `sums`, the sum of a column so far, the row's own value included; of `lows`, the least that
    one of those sums has been so far; of `lasts`, the last value of a column so far that is not null. The order ascends, nulls
    first, and should be total within a key; null keys are a key like any other."""
    sums, lows, lasts = sums or {}, lows or {}, lasts or {}
    part = Window.partitionBy(*keys, "span_")
    here = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = {f"own_{n}_": F.sum(c).over(here) for n, c in sums.items()} | {f"own_{n}_": F.last(c, ignorenulls=True).over(here) for n, c in lasts.items()}
    found = spans(rows, keys, order, parts).withColumns(own).withColumns({f"own_{n}_": F.min(f"own_{of}_").over(here) for n, of in lows.items()})
    # A row a span, then what comes before each
    told = [F.sum(c).alias(f"all_{n}_") for n, c in sums.items()] + [F.min(f"own_{n}_").alias(f"all_{n}_") for n in lows]
    told += [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"all_{n}_") for n, c in lasts.items()]
    before = Window.partitionBy(*keys).orderBy("span_").rowsBetween(Window.unboundedPreceding, -1)
    whole = found.groupBy(*keys, "span_").agg(*told)
    whole = whole.withColumns({f"from_{n}_": F.coalesce(F.sum(f"all_{n}_").over(before), F.lit(0)) for n in sums} | {f"from_{n}_": F.last(f"all_{n}_", ignorenulls=True).over(before) for n in lasts})
    whole = whole.withColumns({f"from_{n}_": F.min(F.col(f"from_{of}_") + F.col(f"all_{n}_")).over(before) for n, of in lows.items()})
    whole = whole.select(*(F.col(k).alias(f"key_{i}_") for i, k in enumerate(keys)), F.col("span_").alias("of_span_"), *(f"from_{n}_" for n in (*sums, *lows, *lasts)))
    same = found["span_"] == whole["of_span_"]
    for i, k in enumerate(keys):
        same &= found[k].eqNullSafe(whole[f"key_{i}_"])
    made = {n: F.col(f"from_{n}_") + F.coalesce(f"own_{n}_", F.lit(0)) for n in sums} | {n: F.coalesce(f"own_{n}_", f"from_{n}_") for n in lasts}
    made |= {n: F.least(F.col(f"from_{of}_") + F.col(f"own_{n}_"), f"from_{n}_") for n, of in lows.items()}
    return found.join(whole, same).select(*rows.columns, *(c.alias(n) for n, c in made.items()))
