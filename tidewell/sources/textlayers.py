"""SRC-20: lines of a document's text layer from its positioned items (doc_id, page, seq, x, y, width, size, text).

Items are what a page draws, in the order in which it does (seq); y grows upwards. A page's items are gathered, cut into runs or
bands, joined in order of x, and numbered from the top."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

PAGE = ("doc_id", "page")
#: Items that are worked on at once, or a page's if these are more
ITEMS = 1 << 17
#: What Unicode calls white space
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _rank(values: pa.Array) -> np.ndarray:
    """Numbers in the order of values, nulls first."""
    if pa.types.is_integer(values.type) and not values.null_count:
        return values.to_numpy()
    return pc.rank(values, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def _changes(values: np.ndarray) -> np.ndarray:
    """Whether each value but the first differs from the one before it; what is not a number equals itself."""
    return (values[1:] != values[:-1]) & ~((values[1:] != values[1:]) & (values[:-1] != values[:-1]))


def _order(text: pa.Array, enough: int, *keys: np.ndarray) -> np.ndarray:
    """The places of items in order of the keys, and then of their texts. Nothing is sorted if keys ascend, as they do where a page is
    drawn as it is read, and no more keys than `enough` if these tell all items apart."""
    less, same = np.zeros(len(text) - 1, bool), np.ones(len(text) - 1, bool)
    for k in keys[:enough]:
        less |= same & (k[:-1] < k[1:])
        same &= k[:-1] == k[1:]
    if less.all():
        return np.arange(len(text))
    order = np.lexsort(keys[:enough][::-1])
    if not np.logical_or.reduce([_changes(k[order]) for k in keys[:enough]]).all():
        order = np.lexsort((_rank(text), *keys[::-1]))
    return order


def _page_lines(pages: pa.RecordBatch, drawn: bool, both_ends: bool) -> pa.RecordBatch | None:
    """The numbered lines of pages (two keys, items), worked out for all of a batch at once."""
    lists = pages.column(2)
    page, items = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()
    if not len(items):
        return None
    seq, text = _rank(items.field("seq")), items.field("text")
    height, x, width, size = (items.field(c).to_numpy(zero_copy_only=False) for c in ("height", "x", "width", "size"))
    order = _order(text, 2, page, seq, height, x, width, size) if drawn else _order(text, 3, page, height, x, seq, width, size)
    starts = np.r_[True, _changes(page[order]) | _changes(height[order])]
    if drawn:  # runs of one height, within which items are in order of x
        run = np.empty(len(order), np.int64)
        run[order] = np.cumsum(starts)
        order = _order(text, 2, run, x, seq, width, size)
    page, height, x, width, size, text = page[order], height[order], x[order], width[order], size[order], text.take(pa.array(order))

    # A space where the gap before an item is more than a third of its size and three units: cells of a table are told apart,
    # letters that are set close are not. What is not a number is more than any number, as in Spark.
    gap, least = np.r_[0.0, x[1:] - (x[:-1] + width[:-1])], np.maximum(3.0, size * 0.35)
    wide = ((gap > least) | (np.isnan(gap) & ~np.isnan(least))) & ~starts & text.is_valid().to_numpy(zero_copy_only=False)
    pieces = pc.binary_join_element_wise(pc.if_else(pa.array(wide), " ", ""), text.fill_null(""), "")
    # Pieces stand one after the other, so lines are the same bytes cut at fewer places
    first = np.flatnonzero(starts)
    ends = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1, pieces.offset * 4)[np.r_[first, len(pieces)]]
    lines = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.tobytes()), pieces.buffers()[2])
    lines = (pc.utf8_trim if both_ends else pc.utf8_rtrim)(lines, characters=WHITE)

    shown = np.flatnonzero(pc.not_equal(lines, "").to_numpy(zero_copy_only=False))
    page, height = page[first][shown], height[first][shown]
    down = np.lexsort((shown, -height, height == height, page))
    page = page[down]
    opens = np.r_[True, page[1:] != page[:-1]][: len(page)]
    n = np.arange(len(page)) - np.maximum.accumulate(np.where(opens, np.arange(len(page)), 0)) + 1
    at = pa.array(page)
    return pa.RecordBatch.from_arrays([pages.column(0).take(at), pages.column(1).take(at), pa.array(n, pa.int32()), lines.take(pa.array(shown[down]))], [*PAGE, "line_no", "text"])


def in_shares(batches: Iterable[pa.RecordBatch], drawn: bool, both_ends: bool) -> Iterator[pa.RecordBatch]:
    """The lines of batches of pages, of so many pages at once that memory is that of ITEMS items, or of one page."""
    for batch in batches:
        ends, begin = batch.column(2).offsets.to_numpy(), 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + ITEMS, "right")) - 1)
            if (found := _page_lines(batch.slice(begin, end - begin), drawn, both_ends)) is not None:
                yield found
            begin = end


def _lines(items: DataFrame, height: Column, drawn: bool, both_ends: bool) -> DataFrame:
    """Items (as _placed gives them) as numbered lines: neighbours of one height, in the order in which they were drawn or from below.

    A page's items are gathered once, as an array, so an item moves no more than once; what is done to them is done to many
    pages of an Arrow batch at once, and no item is asked for by itself."""
    made = items.select(*PAGE, F.struct("seq", height.alias("height"), "x", "width", "size", "text").alias("item"))  # here in generated code, which collect_list is not
    pages = made.groupBy(*PAGE).agg(F.collect_list("item").alias("items"))

    run = lambda batches: in_shares(batches, drawn, both_ends)
    kinds = [made.schema[c] for c in PAGE]
    return pages.mapInArrow(run, StructType([*kinds, StructField("line_no", IntegerType()), StructField("text", StringType())]))


def _placed(items: DataFrame) -> DataFrame:
    kinds = {"x": 0.0, "width": 0.0, "size": 10.0}
    return items.where(F.col("y").isNotNull()).select(*PAGE, "seq", F.col("y").cast("double").alias("y"), "text", *(F.coalesce(F.col(c).cast("double"), F.lit(v)).alias(c) for c, v in kinds.items()))


def stream_lines(items: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, text): items that follow each other at one height are a line; lines go from the top, those of one
    height in the order in which they were drawn. Items without a height, and blank lines, are left out."""
    return _lines(_placed(items), F.col("y"), True, False)


def band_lines(items: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, text): all items of a page at one height, rounded, are a line, whenever they were drawn: labels meet
    the values beside them."""
    return _lines(_placed(items), F.floor(F.col("y") + 0.5), False, True)


def sufficient(items: DataFrame) -> DataFrame:
    """(doc_id, sufficient): whether a text layer can stand for its document: ten lines or more, and on half of its pages at least
    fifty characters. Pages are those that have an item."""
    lines = stream_lines(items).groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    pages = items.groupBy(*PAGE).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n"))
    pages = pages.groupBy("doc_id").agg(F.avg((F.col("n") >= 50).cast("int")).alias("share"))
    return pages.join(lines, "doc_id", "left").select("doc_id", (F.coalesce("n_lines", F.lit(0)) >= 10).alias("long"), "share").select("doc_id", (F.col("long") & (F.col("share") >= 0.5)).alias("sufficient"))
