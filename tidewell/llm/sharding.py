"""Sharding by histogram sort.

Splitters of the key order are found by counting exact rows and bytes below evenly spaced probes, in every partition,
and refining the probes within the cells that need it, until each splitter is within tolerance.  Only then are the
rows exchanged, once."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import materialize

#: Probes an interval; a cell's name has two hexadecimal digits for each refinement, so names sort as keys do.
PROBES = 256


def _digit(x: Column, low: Column, step: Column) -> Column:
    at = F.floor((x.cast("decimal(20,0)") - low.cast("decimal(20,0)")) / step.cast("decimal(20,0)"))
    return F.lower(F.lpad(F.hex(F.least(F.greatest(at.cast("long"), F.lit(0)), F.lit(PROBES - 1))), 2, "0"))


def cells(keys: DataFrame, shards: int, tolerance: float = 0.001, parts: int = 64) -> tuple[DataFrame, list[tuple]]:
    """Keys (a, b, c: longs in order, different for each row; size: long) with a column cell, and the list of cells (name, rows,
    bytes) in key order.

    A cell is refined while it holds more than 1/(shards * parts) of all rows, or a shard boundary by bytes and more than
    `tolerance` of a shard's bytes, unless it is one row. The driver gets one row a cell, and sends as many to the tasks: at
    most PROBES for each of the at most shards * (parts + 1) cells refined at a time, whatever the number of rows."""
    spark = keys.sparkSession
    now = keys.withColumn("cell", F.lit(""))
    while True:
        found = now.groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *(f(c).alias(f.__name__ + c) for f in (F.min, F.max) for c in "abc"))
        found = sorted(found.collect(), key=lambda r: r["cell"])
        rows, total, below, refine = sum(r["n"] for r in found), sum(r["bytes"] for r in found), 0, []
        for r in found:
            inside = any(below < total * k / shards < below + r["bytes"] for k in range(1, shards))
            below += r["bytes"]
            if r["n"] > 1 and (not r["cell"] or r["n"] > max(1, rows / (shards * parts)) or inside and r["bytes"] > max(1, tolerance * total / shards)):
                c = next(c for c in "abc" if r["min" + c] < r["max" + c])
                refine.append((r["cell"], c, r["min" + c], -((r["min" + c] - r["max" + c] - 1) // PROBES)))
        if not refine:
            return now, [(r["cell"], r["n"], r["bytes"]) for r in found]
        if refine[0][0] == "":  # all rows are one cell as yet
            _, c, low, step = refine[0]
            now = now.withColumn("cell", _digit(F.col(c), F.lit(low), F.lit(str(step))))
            continue
        probes = spark.createDataFrame([(c, k, low, str(step)) for c, k, low, step in refine], "cell string, by string, low long, step string")
        probes = probes.select("cell", "by", "low", F.col("step").cast("decimal(20,0)").alias("step"))
        x = F.when(F.col("by") == "a", F.col("a")).when(F.col("by") == "b", F.col("b")).otherwise(F.col("c"))
        now = now.join(F.broadcast(probes), "cell", "left").withColumn("cell", F.when(F.col("by").isNull(), F.col("cell")).otherwise(F.concat("cell", _digit(x, F.col("low"), F.col("step"))))).select(*keys.columns, "cell")


def _placed(rows: DataFrame, shards: int, tolerance: float) -> tuple[DataFrame, list[tuple]]:
    """rows (row: a struct with doc_id, size, text_crc32, b: a hash of the text), written once, with the keys of the order and a
    cell, and for each cell (name, shard, slot of its first row)."""
    keys = rows.withColumn("a", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(2**63)))).withColumn("c", F.monotonically_increasing_id())
    made, found = cells(materialize(keys), shards, tolerance)
    total, ends, below = sum(x[2] for x in found), [], 0
    for x in found:
        ends.append(below := below + x[2])
    # A boundary is the cell end nearest to its share of the bytes
    starts = [0]
    for k in range(1, shards):
        want = total * k / shards
        at = bisect_left(ends, want)
        if at and abs(ends[at - 1] - want) <= abs(ends[min(at, len(ends) - 1)] - want):
            at -= 1
        starts.append(max(starts[-1], min(at + 1, len(ends))))
    named, shard, slot = [], 0, 0
    for i, (cell, n, _) in enumerate(found):
        while shard + 1 < shards and starts[shard + 1] <= i:
            shard, slot = shard + 1, 0
        named.append((cell, shard, slot))
        slot += n
    return made, named


def _slots(made: DataFrame, named: list[tuple]) -> DataFrame:
    """made with shard and slot.  Its rows are numbered within their cells, each a small share of all rows."""
    places = made.sparkSession.createDataFrame(named, "cell string, shard int, first long")
    place = F.row_number().over(Window.partitionBy("cell").orderBy("a", "b", "c"))
    return made.withColumn("place", place).join(F.broadcast(places), "cell").withColumn("slot", F.col("first") + F.col("place") - 1)


def _measured(docs: DataFrame, *kept: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    return docs.select(row, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("b"))


def assign(docs: DataFrame, shards: int = 8, tolerance: float = 0.001) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row: sizes of shards are near equal, doc_ids ascend from shard to
    shard and slots, gapless from 0 in a shard, ascend with them.

    size is the UTF-8 bytes of the text (null: none) plus 1. Null ids come first; equal ids go by a hash of their text, and
    rows equal in both by a number given to each row, so any number of equal rows is split; an empty table gives no rows."""
    made = _slots(*_placed(_measured(docs, "doc_id"), shards, tolerance))
    return made.select(F.col("row.doc_id").cast("long").alias("doc_id"), "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, tolerance: float = 0.001) -> None:
    """Write all columns of docs, and each row's slot, as Parquet below shard=N folders; within a file slots ascend.  Columns
    of docs that are named shard or slot give way.

    Rows are written once as they are read, to fix their order, and exchanged once, by ranges of cells."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    made, named = _placed(_measured(docs, *kept), shards, tolerance)
    parts = max(shards, int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _slots(made.repartitionByRange(parts, "cell"), named).sortWithinPartitions("shard", "slot")
    rows.select("row.*", "slot", "shard").write.partitionBy("shard").parquet(path)
