"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def scratch(spark: SparkSession) -> str:
    """A fresh path below the shared folder named in spark.checkpoint.dir.

    Where that setting is absent, a local session gets a temporary folder of its own; a cluster session is
    an error, since its executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidewell/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives the loss of executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(made: DataFrame) -> None:
    """Delete what materialize wrote for `made`, once all that was made of it is written too."""
    spark = made.sparkSession
    for folder in {f.rpartition("/")[0] for f in made.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _typed(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows, so that what is made of a part stays small; empty ones are left out.
    What Arrow no longer needs goes back to the system after each batch, as the worker may idle beside others."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b
        pa.default_memory_pool().release_unused()


def map_arrow(df: DataFrame, rows, schema: str) -> DataFrame:
    """mapInArrow of a function from a batch's columns (as Python lists) to a dict of arrays."""
    target = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in slices(batches):
            made = rows(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([_typed(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 on an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15 | 1, np.uint64))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words of a UTF-8 text."""
    inside = ~_IS_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, with the words' starts and ends in bytes.

    The hash is a polynomial over the word's bytes, finished by mix64, and is computed for all words at once."""
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    raw = np.frombuffer(data, np.uint8)
    at = np.arange(len(raw), dtype=np.int64)
    begin = np.zeros(len(raw), np.int64)
    begin[starts] = starts
    at -= np.maximum.accumulate(begin)
    values = ((_LOWER[raw] if lower else raw).astype(np.uint64) + np.uint64(1)) * _POWERS[at & (len(_POWERS) - 1)]
    values[_IS_SPACE[raw]] = 0
    return mix64(np.add.reduceat(values, starts) + (ends - starts).astype(np.uint64)), starts, ends


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; of the whole sequence where it is shorter; none where it is empty."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD1342543DE82EF95) + words[k : n - width + 1 + k]
    return mix64(out + np.uint64(width))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (src, dst), component being the smallest node reachable.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until no edge changes. A round
    is written to the shared folder, so lineage stays short; nothing but two numbers a round reaches the driver.
    Self-loops keep their node; null ends are dropped. An empty input gives an empty result."""
    edges = materialize(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).dropna())  # read twice
    nodes = edges.select("src").union(edges.select("dst")).distinct().withColumnRenamed("src", "node")
    now = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        large = materialize(large)
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        now = materialize(small.union(least.select("src", F.col("m").alias("dst"))).distinct())
    labels = now.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
