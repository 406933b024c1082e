"""Finite automata over ordered rows.

What a row does is an array: the next state for each state. Arrays compose, so spans of rows are reduced to one array each; the
spans tell the state in which each begins, and only then are the states within the spans told."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Rows of a span: the most that are composed one after the other.
SPAN = 64


def _walked(moves: np.ndarray, first: np.ndarray, start: int, now: int) -> tuple[np.ndarray, int]:
    """The state before each row, and the one after the last: moves has a row's next states, first tells where a key begins, and
    now is the state before the first row."""
    n, k = moves.shape
    padded = np.tile(np.arange(k, dtype=moves.dtype), (-(-n // SPAN) * SPAN, 1))
    padded[:n] = moves
    begins = np.zeros(len(padded), bool)
    begins[:n] = first
    spans, begins = padded.reshape(-1, SPAN, k), begins.reshape(-1, SPAN)
    met = np.empty_like(spans)  # the state before a row, for each state before its span
    so_far = np.tile(np.arange(k, dtype=moves.dtype), (len(spans), 1))
    for i in range(SPAN):
        so_far[begins[:, i]] = start
        met[:, i] = so_far
        so_far = np.take_along_axis(spans[:, i], so_far, 1)
    opening = np.empty(len(spans), np.int64)
    for j, whole in enumerate(so_far.tolist()):
        opening[j], now = now, whole[now]
    return np.take_along_axis(met, opening[:, None, None], 2).reshape(-1)[:n], now


def states_before(rows: DataFrame, keys: list[str], order: list[str], moves: Column, n_states: int, start: int = 0, name: str = "state") -> DataFrame:
    """rows with state (or `name`): the number of the state in which each is met, keys beginning in `start`. moves is an array of n_states
    numbers. The order should be total within a key; a key's rows are read in that order, in Arrow batches, with one number kept
    from one to the next, so they move and are sorted once at most, and none are gathered."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    placed = rows.withColumn("first_", first).select(F.struct(*rows.columns).alias("row"), moves.cast("array<int>").alias("moves"), "first_")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = start
        for batch in batches:
            if batch.num_rows:
                told = batch.column(1).flatten().to_numpy().reshape(-1, n_states)
                states, now = _walked(told, batch.column(2).to_numpy(zero_copy_only=False), start, now)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(states, pa.int32())], ["row", "state"])

    met = placed.mapInArrow(walk, StructType([placed.schema["row"], StructField("state", IntegerType())]))
    return met.select("row.*", F.col("state").alias(name))
