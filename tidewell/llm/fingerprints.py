"""Document fingerprints by content-defined chunking.

Boundaries come from a gear hash over the UTF-8 bytes with normalised chunking: up to a normal size a strict mask
must be zero, beyond it a looser one, between a least and a greatest length.  An edit moves only the boundaries near
it.  A fingerprint is the set of chunk digests, each with its chunk's length, written as text in ascending order:
14 hexadecimal digits of digest and 2 of length a chunk.  Containment weighs the shared chunks by their lengths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import mix64

LEAST, NORMAL, MOST = 12, 32, 128
#: Bits of the gear hash that must be zero: a chunk ends with probability 1/64 a byte at first, then 1/8.
LOOSE = np.uint32(0xE0000000)
STRICT = np.uint32(0xFC000000)
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def boundaries(data: bytes, start: int = 0) -> list[int]:
    """Ends of the chunks of data from the chunk start `start` on."""
    n = len(data)
    if start >= n:
        return []
    base = max(0, start - 31)
    h = GEAR[np.frombuffer(data, np.uint8)[base:]]
    for k in range(5):  # after step k the hash spans 2^(k+1) bytes
        s = 1 << k
        shifted = h.copy()
        shifted[s:] += h[:-s] << np.uint32(s)
        h = shifted
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = ((h[loose] & STRICT) == 0).tolist()
    ends, at = [], start
    for p, hard in zip((loose + base + 1).tolist(), strict):
        while p - at > MOST:
            at += MOST
            ends.append(at)
        if p - at >= LEAST and (hard or p - at >= NORMAL):
            at = p
            ends.append(at)
    while n - at > MOST:
        at += MOST
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def digests(data: bytes, ends: list[int], at: int = 0) -> dict[int, int]:
    """Digest to length of the chunks that begin at `at` and end at `ends`."""
    made = {}
    for e in ends:
        made[xxhash.xxh3_64_intdigest(data[at:e]) >> 8] = e - at
        at = e
    return made


def chunk_set(text: str | None) -> dict[int, int]:
    data = (text or "").encode()
    return digests(data, boundaries(data))


def encode(chunks: dict[int, int]) -> str:
    return "".join(f"{d:014x}{n:02x}" for d, n in sorted(chunks.items()))


def decode(fingerprint: str) -> dict[int, int]:
    return {int(fingerprint[i : i + 14], 16): int(fingerprint[i + 14 : i + 16], 16) for i in range(0, len(fingerprint), 16)}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's bytes in chunks that b has too; an empty a is contained in an empty b only."""
    if not a:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of column `text` as a further column (replaced where it exists); null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([encode(chunk_set(t.as_py())) for t in b.column(text)], pa.string())
            kept = [(f, c) for f, c in zip(b.schema, b.columns) if f.name != out]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [made], schema=pa.schema([f for f, _ in kept] + [pa.field(out, pa.string())]))

    docs = docs.drop(out)
    return docs.mapInArrow(run, docs.withColumn(out, F.lit("")).schema)


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, last, doc_id, text) of all documents, dealt by ranges of doc_id and sorted within partitions; each range
    is followed by a copy, marked last, of the document that comes next.

    The range starts are doc_ids that occur, found from the ids alone; so one exchange of the texts is enough, and
    only one extra row a range is sent. Null ids sort first; equal ids sort by text."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    buckets = buckets or max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    share = [i / buckets for i in range(buckets)]
    starts = docs.agg(F.min(key), F.percentile_approx(key, F.array(*map(F.lit, share)), 100 * buckets)).first()
    if starts[0] is None:
        return docs.select(F.lit(0).alias("bucket"), F.lit(False).alias("last"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    cuts = sorted({starts[0], *starts[1]})
    own = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("key"))) - 1
    before = (F.col("own") - 1 + len(cuts)) % len(cuts)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), key.alias("key")).withColumn("own", own)
    at = F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("last")))
    more = F.array(F.struct(before.alias("bucket"), F.lit(True).alias("last")))
    dealt = rows.select("doc_id", "text", "key", F.inline(F.when(F.col("key").isin(cuts), F.concat(at, more)).otherwise(at)))
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "last", "key", "text").select("bucket", "last", "doc_id", "text")


def edited_text(text: str, following: str) -> str:
    """text with its last half replaced by as many characters of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """For each document its fingerprint, that of its edited text, and its containment in both the edited text and the
    next document in order of doc_id (after the last comes the first).

    Null texts count as empty; an empty text has the empty fingerprint. A single document is its own next one. Other
    columns of docs are not kept."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def row(text, data, chunks, ends, following, next_chunks):
        edited = edited_text(text, following)
        new = edited.encode()
        if new == data:
            other = chunks
        else:
            half = len(text[: len(text) - len(text) // 2].encode())
            same = [e for e in ends if e <= half and e < len(new)]
            # A chunk's end depends on its own bytes and up to 31 before it, so ends within the kept half stay
            other = digests(new, same + boundaries(new, same[-1] if same else 0))
        return (len(text), hashlib.sha256(new).hexdigest(), encode(chunks), encode(other), containment(chunks, other), containment(chunks, next_chunks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the document whose next one is not known yet
        for b in batches:
            made = []
            for bucket, last, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                if last and waiting is None:
                    continue  # more rows with the id of the next range's first
                text = text or ""
                data = text.encode()
                ends = boundaries(data)
                chunks = digests(data, ends)
                if waiting:
                    made.append((waiting[0], *row(*waiting[1:], text, chunks)))
                waiting = None if last else (doc_id, text, data, chunks, ends)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*made)) or [[]] * 7, ARROW)], names=NAMES)

    return with_next(docs).mapInArrow(run, schema)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
ARROW = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
