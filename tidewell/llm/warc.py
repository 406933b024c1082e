"""WARC archives: writing pages as segmented records, and reading them back.

A page is an HTTP response in chunked transfer framing.  A block longer than SEGMENT bytes is cut into a first record and
continuation records, which name the first one's id as their origin and carry a segment number; the last one tells the
total length.  The reader groups segments by origin, orders them by number, verifies numbers and length, and takes the
framing off.  Archive files are written by Spark's text writer, one record a row, with the CRLF that ends a record as
the separator; so any file system that Spark knows will do, and a lost executor's files are written again."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, scratch

VERSION = b"WARC/1.1"
#: Bytes of a record's block, of an HTTP chunk, and of the payloads that later equal ones revisit.
SEGMENT, CHUNK, REVISIT = 4096, 1500, 1000
#: Bytes of records that are read before they are handed on.
GROUP = 4_000_000
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
#: A row of an archive file read back.
RECORD = "id string, origin string, segment int, total long, type string, page_id long, uri string, refers_to long, digest string, length long, block binary, row long"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = (payload[i : i + size] for i in range(0, len(payload), size))
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are ignored.  ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record_id(page_id, part: int = 1) -> str:
    return f"<urn:tidewell:page:{'' if page_id is None else page_id}:{part}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n"


def records(page_id, url: str | None, html: str | None, refers_to, digest: str, row: int = 0, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of a page, each with all but the last CRLF.  row tells pages with the same id apart."""
    payload = (html or "").encode()
    uri = " ".join((url or "").split())
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Page-ID", page_id), ("WARC-Page-Row", row)]
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page_id)), *common, ("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Payload-Digest", digest), ("WARC-Payload-Length", len(payload))], HTTP + b"\r\n")
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for k, part in enumerate(parts, 1):
        more = [("WARC-Payload-Digest", digest)] if k == 1 else [("WARC-Segment-Origin-ID", record_id(page_id))]
        if len(parts) > 1:
            more.append(("WARC-Segment-Number", k))
            more += [("WARC-Segment-Total-Length", len(block))] * (k == len(parts))
        yield _record([("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", record_id(page_id, k)), *common, *more], part)


def parse(archive: BinaryIO) -> Iterator[tuple]:
    """The records of an archive, in the order of RECORD, read one after the other.  Head lines that continue on the next
    line are not read; ValueError where a record is cut off or does not have the length told."""
    while version := archive.readline():
        if version.rstrip(b"\r\n") != VERSION:
            raise ValueError(f"no record begins with {version[:40]!r}")
        h = {}
        while (line := archive.readline()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise ValueError("an archive ends within the head of a record")
            name, _, value = line.decode().partition(":")
            h[name] = value.strip()
        n = int(h["Content-Length"])
        block = archive.read(n)
        if len(block) != n or archive.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record {h['WARC-Record-ID']} does not end where its length says")
        refers = h.get("WARC-Refers-To")
        number = lambda k: int(h[k]) if h.get(k) else None
        yield (h["WARC-Record-ID"], h.get("WARC-Segment-Origin-ID"), number("WARC-Segment-Number"), number("WARC-Segment-Total-Length"), h["WARC-Type"],
               number("WARC-Page-ID"), h.get("WARC-Target-URI"), int(refers.split(":")[3]) if refers else None, h.get("WARC-Payload-Digest"), number("WARC-Payload-Length"), block, number("WARC-Page-Row"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write a response or a revisit record for each row of pages (page_id, url, html; null html is an empty payload).

    Of records with equal payloads of at least 1000 bytes the one with the largest page_id is the response; a null page_id
    is smaller than any other and, like repeated page_ids, never refers to itself.  The groups of equal payloads are found
    from digests; a page's html moves only if Spark does not judge the table of such groups small enough to send."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
    groups = rows.where(f"n >= {REVISIT}").groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("rows")).where("rows > 1")
    groups = materialize(groups.select(F.col("digest").alias("of"), "newest"))
    both = rows.join(groups, rows["digest"] == groups["of"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [r for x in zip(*(c.to_pylist() for c in b.columns)) for r in records(*x, segment=segment)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    made = both.select("page_id", "url", "html", refers.alias("refers_to"), "digest", F.monotonically_increasing_id().alias("row")).mapInArrow(render, "record binary")
    made.select(F.col("record").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archive files below path, parsed by their own lengths.

    A task holds one archive as it is stored and a group of records of up to GROUP bytes; what is compressed is unpacked as
    it is read, also where an archive has one gzip member a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(target)
        for b in batches:
            for name, content in zip(*(c.to_pylist() for c in b.columns)):
                raw = io.BytesIO(content)
                found, held = [], 0
                for r in parse(gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw):
                    found.append(r)
                    held += len(r[10]) + 500
                    if held > GROUP:
                        yield _batch(found, schema)
                        found, held = [], 0
                yield _batch(found, schema)

    target = spark.createDataFrame([], RECORD).schema
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, target)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


PAGE = "page_id long, url string, payload binary, record_type string, refers_to long, digest string, payload_bytes long"


def _page(parts: list[tuple]) -> tuple:
    """A page from its records in order of segment number."""
    first = parts[0]
    if first[4] == "revisit":
        return (first[5], first[6], None, "revisit", first[7], first[8], first[9])
    block = b"".join(p[10] for p in parts)
    if [p[2] for p in parts] != ([None] if len(parts) == 1 else list(range(1, len(parts) + 1))) or parts[-1][3] not in (None, len(block)) or len(parts) > 1 and parts[-1][3] is None:
        raise ValueError(f"segments of {first[0]} are missing or do not have the length told")
    payload = payload_of(block)
    if hashlib.sha1(payload).hexdigest() != first[8]:
        raise ValueError(f"the payload of {first[0]} does not have the digest told")
    return (first[5], first[6], payload, "response", None, first[8], len(payload))


def reassemble(records: DataFrame) -> DataFrame:
    """(page_id, url, payload, record_type, refers_to, digest, payload_bytes): a row for each first record.

    Whole records are decoded where they are; only segments are exchanged, by origin, and put together in order, so a task
    holds one record at a time.  Missing segments, wrong lengths, framing or digests raise."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = records.sparkSession.createDataFrame([], PAGE).schema

    def alone(batches):
        for b in batches:
            if b.num_rows:
                yield _batch([_page([r]) for r in zip(*(c.to_pylist() for c in b.columns))], to_arrow_schema(target))

    def joined(batches):
        key, parts = None, []
        for b in batches:
            made = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                this = (r[0] if r[1] is None else r[1], r[11])
                if parts and this != key:
                    made.append(_page(parts))
                    parts = []
                key = this
                parts.append(r)
            yield _batch(made, to_arrow_schema(target))
        if parts:
            yield _batch([_page(parts)], to_arrow_schema(target))

    whole = records.where("segment is null").mapInArrow(alone, target)
    split = records.where("segment is not null").withColumn("key", F.coalesce("origin", "id"))
    split = split.repartition("key", "row").sortWithinPartitions("key", "row", "segment").drop("key").mapInArrow(joined, target)
    return whole.union(split)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder, read them back, and tell of each page: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = scratch(spark)
    write_archives(pages, path)
    records = read_records(spark, path)
    return reassemble(records).select("page_id", "url", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
