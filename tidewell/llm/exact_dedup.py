"""Exact copies by two passes of Bloom filters.

The first pass adds the hash of each text to a filter, and what a filter holds already to a second one. The second pass asks
the second filter: a text that it does not know has no copy and stays where it is; only the others are dealt out by a digest
of the whole text, which decides. A filter never forgets, so no copy is missed; what it takes for known by chance is dealt
out too and found alone.

A filter has 16 bits a row and is cut into segments of SEGMENT bits by the first bits of the hash, so that filters of tasks
merge segment by segment. Where that is more than `most_bits`, the range of hashes is cut into rounds, each with the filter of
its own segments; hashes are stored in order within a file, so a round reads its part of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, slices

#: Bits of a segment (a power of two), bits of a row in a filter, bits that a hash sets, and the fewest segments.
SEGMENT, ROW_BITS, SET_BITS, FEWEST = 1 << 15, 16, 4, 64
#: The largest filter that is sent to all tasks: 32 MB; a task that fills the two filters holds twice that.
MOST_BITS = 1 << 28


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _segment(h: Column, segments: int) -> Column:
    return F.shiftright(h, 64 - (segments.bit_length() - 1))


def _places(h: Column) -> Column:
    """60 bits more of a hash, four places of a segment."""
    return F.xxhash64(h)


def _split(p: np.ndarray) -> np.ndarray:
    """A row for each place of the hashes' further bits."""
    return np.stack([(p >> np.int64(15 * k)) & np.int64(SEGMENT - 1) for k in range(SET_BITS)])


def task_filters(hashes: DataFrame, first: int, count: int) -> DataFrame:
    """(segment, once, twice) from (h, segment, places): a task's filter of the hashes that it has seen, and of those that it
    has seen before. Segments that it has none of are left out; a task holds `count` segments of both, from segment `first`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros(count * SEGMENT // 8, np.uint8) for _ in range(2))
        for b in slices(batches, 1 << 16):
            h, at, n = np.unique(b.column("h").to_numpy(), return_index=True, return_counts=True)
            base = (b.column("segment").to_numpy()[at].astype(np.int64) - first) * SEGMENT
            places = _split(b.column("places").to_numpy()[at]) + base
            byte, bit = places >> 3, np.left_shift(1, places & 7).astype(np.uint8)
            seen = (n > 1) | ((once[byte] & bit) != 0).all(0)
            np.bitwise_or.at(twice, byte[:, seen].ravel(), bit[:, seen].ravel())
            np.bitwise_or.at(once, byte.ravel(), bit.ravel())
        once, twice = once.reshape(count, -1), twice.reshape(count, -1)
        used = np.flatnonzero(once.any(1))
        for at in range(0, len(used), 256):
            part = used[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part + first, pa.int64()), *(pa.array([x[i].tobytes() for i in part], pa.binary()) for x in (once, twice))], names=["segment", "once", "twice"])

    return hashes.mapInArrow(run, "segment long, once binary, twice binary")


def merged_filters(parts: DataFrame) -> DataFrame:
    """(segment, twice): the second filter of all tasks. A hash that two tasks have seen once has its bits in both their first
    filters. Rows of a segment are folded as they come, so a task holds one segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([twice.tobytes()], pa.binary())], names=["segment", "twice"])
        for b in slices(batches):
            for segment, a, t in zip(*(c.to_pylist() for c in b.columns)):
                a, t = np.frombuffer(a, np.uint8), np.frombuffer(t, np.uint8)
                if segment == now:
                    twice, once = twice | t | (once & a), once | a
                    continue
                if now is not None and twice.any():
                    yield out()
                now, once, twice = segment, a, t
        if now is not None and twice.any():
            yield out()

    return parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "segment long, twice binary")


def _known(filter_bits: Column, places: Column) -> Column:
    """Whether all places of a hash are set in its segment of the filter."""
    out = filter_bits.isNotNull()
    for k in range(SET_BITS):
        at = F.shiftright(places, 15 * k).bitwiseAND(F.lit(SEGMENT - 1)).cast("int")
        byte = F.conv(F.hex(F.substring(filter_bits, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        out &= F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1
    return out


def possibly_repeated(rows: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """rows (h: a 64-bit hash, and more columns; a written table) with a column repeated: false only where no other row has the
    same h. What is sent to all tasks is one filter of at most `most_bits` bits a round; no row is dealt out."""
    n = max(1, rows.count())
    segments = max(FEWEST, 1 << (ROW_BITS * n // SEGMENT).bit_length())
    a_round = max(1, min(segments, most_bits // SEGMENT))
    width = 1 << (64 - (segments.bit_length() - 1))  # of the hashes of a segment
    made = []
    for first in range(-segments // 2, segments // 2, a_round):
        low, high = first * width, min((first + a_round) * width, 1 << 63) - 1
        own = rows if a_round == segments else rows.where(F.col("h").between(F.lit(low), F.lit(high)))
        own = own.withColumn("segment", _segment(F.col("h"), segments)).withColumn("places", _places(F.col("h")))
        known = materialize(merged_filters(task_filters(own.select("h", "segment", "places"), first, a_round)))
        both = own.join(F.broadcast(known), "segment", "left")
        made.append(both.withColumn("repeated", F.coalesce(_known(F.col("twice"), F.col("places")), F.lit(False))).select(*rows.columns, "repeated"))
    return reduce(DataFrame.unionAll, made)


def _hashed(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, text_sha256, h, row_: a number of the row, and more) of docs, written in the order of h within each file."""
    text = normalised(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row_"), *more)
    return materialize(rows.sortWithinPartitions("h"))


def _groups(some: DataFrame) -> DataFrame:
    """(text_sha256, best, group_size): of each text the largest id, and the row that stays. Counted before rows are dealt out."""
    return some.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row_")).alias("best"), F.count("*").alias("group_size"))


def copies(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of docs (doc_id, text), dropped ones too.

    Rows are copies if their texts are equal after lower-casing A-Z only (told by SHA-256 of the whole text; null counts as
    empty). Of a group the row with the largest doc_id stays, a null id being the smallest; of rows that repeat that id one
    stays. Rows whose hash the filter does not know pass straight through. A group of any size is one row on one side of the
    join of the others, so Spark can split it. An empty table gives no rows."""
    rows = materialize(possibly_repeated(_hashed(docs), most_bits))
    alone = rows.where("not repeated").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = rows.where("repeated")
    both = some.join(_groups(some), "text_sha256")
    return alone.unionByName(both.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row_") == F.col("best.row_")).alias("kept"), "text_sha256"))


def deduplicated(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of docs that stay of copies, with all their columns; which those are, copies() tells. The rows are written once,
    in the order of their hashes within a file; only texts that the filter knows are dealt out."""
    rows = possibly_repeated(_hashed(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept_")), most_bits)
    best = _groups(rows.where("repeated")).select("text_sha256", F.col("best.row_").alias("row_"))
    stay = rows.where("repeated").join(materialize(best), ["text_sha256", "row_"], "left_semi")
    return rows.where("not repeated").select("kept_.*").unionAll(stay.select("kept_.*"))
