"""SRC-01, SRC-04 and SRC-08: spreadsheets in zipped XML, read and written without a spreadsheet library.

Files come as (path, content), which is what Spark's binaryFile source gives, from any store that Spark can read. A task unpacks
a workbook and streams its sheets row by row; what it holds is the zipped file and the workbook's texts. A sheet has at most
1,048,576 rows by its format, so a workbook is a bounded unit of work and many of them are read side by side."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from xml.etree.ElementTree import ParseError, iterparse
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.storage import written
from tidewell.sources import readers

ROWS = "file string, sheet int, sheet_name string, row_no int, cells array<string>"
BATCH = 1000

# Numbers of the built-in formats that show a date or a time
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
# Columns of a sales export by chart system, and where its amount stands if the header does not tell
INTOVET = {"service_date": 0, "customer_no": 1, "customer_name": 2, "patient_name": 3, "receipt_no": 5}
INTOVET_AMOUNT = 70


@lru_cache(4096)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _elements(archive: zipfile.ZipFile, name: str, wanted: str) -> Iterator:
    """The elements of one name in a part of the archive; each is forgotten once the next is asked for."""
    with archive.open(name) as part:
        for _, e in iterparse(part):
            if _local(e.tag) == wanted:
                yield e
                e.clear()


def _part(target: str) -> str:
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _text(e) -> str:
    """The text of a string item, without its phonetic notes."""
    return "".join(t.text or "" for child in e for t in (child.iter() if _local(child.tag) != "rPh" else ()) if _local(t.tag) == "t")


def _is_date_format(code: str) -> bool:
    return bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.lower()))) and code.lower() != "general"


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """The cell styles that show a date."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    own, styles, inside = set(_DATE_FORMATS), [], False
    with archive.open("xl/styles.xml") as part:
        for event, e in iterparse(part, ("start", "end")):
            tag = _local(e.tag)
            if tag == "cellXfs":
                inside = event == "start"
            elif event == "end" and tag == "numFmt" and _is_date_format(e.get("formatCode", "")):
                own.add(int(e.get("numFmtId")))
            elif event == "end" and tag == "xf" and inside:
                styles.append(int(e.get("numFmtId", 0)))
    return {i for i, f in enumerate(styles) if f in own}


@lru_cache(4096)
def _shown_date(serial: float, from_1904: bool) -> str:
    """A date, with a time if there is one, from its serial number; the first one counts a day in 1900 that was not."""
    base = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30) + timedelta(days=serial < 60)
    at = base + timedelta(seconds=round(serial * 86400))
    return at.strftime("%Y-%m-%d" if (at.hour, at.minute, at.second) == (0, 0, 0) else "%Y-%m-%d %H:%M:%S")


@lru_cache(32768)
def _column(letters: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", letters)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _sheets(archive: zipfile.ZipFile) -> tuple[list[tuple[str, str]], bool]:
    """(name, part) of the sheets in their order, and whether days are counted from 1904."""
    targets = {e.get("Id"): _part(e.get("Target")) for e in _elements(archive, "xl/_rels/workbook.xml.rels", "Relationship")}
    told = lambda e, name: next((v for k, v in e.attrib.items() if _local(k) == name), None)
    sheets = [(e.get("name"), targets[told(e, "id")]) for e in _elements(archive, "xl/workbook.xml", "sheet")]
    return sheets, any(e.get("date1904") in ("1", "true") for e in _elements(archive, "xl/workbook.xml", "workbookPr"))


def _cell(c, strings: list[str], dates: set[int], from_1904: bool) -> str:
    kind, value = c.get("t", "n"), ""
    for v in c:
        if _local(v.tag) == "v":
            value = v.text or ""
            break
    if kind == "inlineStr":
        return "".join(_text(i) for i in c if _local(i.tag) == "is")
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind == "n" and value and int(c.get("s", 0)) in dates:
        return _shown_date(float(value), from_1904)
    return value


def sheet_rows(content: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """(sheet, its name, row number, cells) of a workbook's rows that have a cell, in order. Cells that are left out are empty;
    dates are shown as 2024-03-09 or 2024-03-09 10:30:00, other numbers as they are stored."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        sheets, from_1904 = _sheets(archive)
        strings = [_text(e) for e in _elements(archive, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in archive.namelist() else []
        dates = _date_styles(archive)
        for k, (name, part) in enumerate(sheets):
            last = 0
            for row in _elements(archive, part, "row"):
                last, cells = int(row.get("r", last + 1)), []
                for c in row:
                    if reference := c.get("r"):
                        cells += [""] * (_column(reference.rstrip("0123456789")) - len(cells))
                    cells.append(_cell(c, strings, dates, from_1904))
                if cells:
                    yield k, name, last, cells


def rows(files: DataFrame) -> DataFrame:
    """A row for each row of each sheet of files (path, content); what is no workbook gives none (see unreadable)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path, found = b.column(0)[i].as_py(), []
                try:
                    for row in sheet_rows(b.column(1)[i].as_py()):
                        found.append((path, *row))
                        if len(found) == BATCH:
                            yield _batch(found)
                            found = []
                except (zipfile.BadZipFile, ParseError, KeyError):
                    continue
                if found:
                    yield _batch(found)

    return files.select("path", "content").mapInArrow(run, ROWS)


def _batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*found), kinds)], names=["file", "sheet", "sheet_name", "row_no", "cells"])


def unreadable(files: DataFrame) -> DataFrame:
    """(path, reason) of files that are no workbooks; their rows are read through to the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                try:
                    for _ in sheet_rows(b.column(1)[i].as_py()):
                        pass
                except (zipfile.BadZipFile, ParseError, KeyError) as e:
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()]), pa.array([f"{type(e).__name__}: {e}"])], names=["path", "reason"])

    return files.select("path", "content").mapInArrow(run, "path string, reason string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the workbooks at a path or pattern."""
    return rows(spark.read.format("binaryFile").load(path))


# --- Writing

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


@lru_cache(32768)
def _name(at: int) -> str:
    out = ""
    at += 1
    while at:
        at, r = divmod(at - 1, 26)
        out = chr(65 + r) + out
    return out


@lru_cache(4096)
def _serial(value: str) -> str:
    return repr((datetime.fromisoformat(value) - datetime(1899, 12, 30)) / timedelta(days=1))


class _Book:
    """A workbook being written, sheet after sheet and row after row; texts are kept once each, rows go to the archive some at a
    time."""

    def __init__(self):
        self.bytes, self.sheets, self.strings, self.part, self.waiting = io.BytesIO(), [], {}, None, []
        self.archive = zipfile.ZipFile(self.bytes, "w", zipfile.ZIP_DEFLATED)

    def row(self, sheet: str, row_no: int, kinds: list[str], values: list[str]) -> None:
        if not self.sheets or self.sheets[-1] != sheet:
            self._close()
            self.sheets.append(sheet)
            self.part = self.archive.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w")
            self.part.write(f"{_HEAD}<worksheet {_MAIN}><sheetData>".encode())
        shown = "".join([self._cell(f"{_name(i)}{row_no}", kind, value) for i, (kind, value) in enumerate(zip(kinds, values)) if value])
        self.waiting.append(f'<row r="{row_no}">{shown}</row>')
        if len(self.waiting) == BATCH:
            self._flush()

    def _cell(self, at: str, kind: str, value: str) -> str:
        if kind == "number":
            return f'<c r="{at}"><v>{escape(value)}</v></c>'
        if kind == "date":
            return f'<c r="{at}" s="1"><v>{_serial(value)}</v></c>'
        return f'<c r="{at}" t="s"><v>{self.strings.setdefault(_NO_XML.sub("", value), len(self.strings))}</v></c>'

    def _flush(self) -> None:
        self.part.write("".join(self.waiting).encode())
        self.waiting.clear()

    def _close(self) -> None:
        if self.part:
            self._flush()
            self.part.write(b"</sheetData></worksheet>")
            self.part.close()

    def done(self) -> bytes:
        self._close()
        n = range(1, len(self.sheets) + 1)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        put = lambda name, text: self.archive.writestr(name, _HEAD + text)
        put("xl/sharedStrings.xml", f"<sst {_MAIN}>" + "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in self.strings) + "</sst>")
        put("xl/styles.xml", f'<styleSheet {_MAIN}><fonts><font/></fonts><fills><fill/></fills><borders><border/></borders><cellStyleXfs><xf/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>')
        put("xl/workbook.xml", f'<workbook {_MAIN} xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(n, self.sheets)) + "</sheets></workbook>")
        rel = lambda i, what, target: f'<Relationship Id="rId{i}" Type="{_OFFICE}/{what}" Target="{target}"/>'
        rels = lambda inside: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inside}</Relationships>'
        put("xl/_rels/workbook.xml.rels", rels("".join(rel(i, "worksheet", f"worksheets/sheet{i}.xml") for i in n) + rel(len(n) + 1, "styles", "styles.xml") + rel(len(n) + 2, "sharedStrings", "sharedStrings.xml")))
        put("_rels/.rels", rels(rel(1, "officeDocument", "xl/workbook.xml")))
        parts = [("/xl/workbook.xml", "sheet.main"), ("/xl/styles.xml", "styles"), ("/xl/sharedStrings.xml", "sharedStrings"), *((f"/xl/worksheets/sheet{i}.xml", "worksheet") for i in n)]
        put("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="{p}" ContentType="{kind}.{k}+xml"/>' for p, k in parts) + "</Types>")
        self.archive.close()
        return self.bytes.getvalue()


def cell(value: Column, kind: str = "text") -> Column:
    """A cell for packed(): text, number or date (a date or timestamp)."""
    shown = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss") if kind == "date" else value.cast("string")
    return F.struct(F.lit(kind).alias("kind"), shown.alias("value"))


def packed(sheets: DataFrame) -> DataFrame:
    """(path, content): a workbook for each file of sheets (file, sheet, sheet_name, row_no, cells: an array of cell()s). Rows go
    to the archive as they come in order, so a task holds one workbook, zipped. Empty cells and rows beyond a gap stay out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([book.done()], pa.binary())], names=["path", "content"])
        now, book = None, None
        for b in batches:
            kinds, values = (c.to_pylist() for c in b.column(3).values.flatten())
            ends = b.column(3).offsets.to_pylist()
            for file, name, row_no, begin, end in zip(*(c.to_pylist() for c in b.columns[:3]), ends, ends[1:]):
                if file != now:
                    if book:
                        yield out()
                    now, book = file, _Book()
                book.row(name, row_no, kinds[begin:end], values[begin:end])
        if book:
            yield out()

    # A number that is asked for, as small partitions would be put together by their bytes, not by the work on them; some a core,
    # as each task begins with a start of Python
    spark = sheets.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    ordered = sheets.repartition(tasks, "file").sortWithinPartitions("file", "sheet", "row_no")
    return ordered.select("file", "sheet_name", "row_no", "cells").mapInArrow(run, "path string, content binary")


# --- What the workbooks hold


def _at(i: int | Column) -> Column:
    return F.get("cells", F.lit(i) if isinstance(i, int) else i)


def amount_positions(head: DataFrame, fallback: int, group: str = "청구금액", name: str = "합계") -> DataFrame:
    """SRC-02: (file, at) from the two header rows of each file: under the group's name, which holds to its right until the next
    one, the column with the given name; else the fallback."""
    both = head.groupBy("file").agg(*(F.max(F.when(F.col("row_no") == n, F.transform("cells", lambda x: F.trim(x)))).alias(c) for n, c in ((1, "upper"), (2, "lower"))))
    held = lambda i: F.try_element_at(F.filter(F.slice("upper", F.lit(1), i), lambda x: x != ""), F.lit(-1))
    fits = F.filter(F.sequence(F.lit(1), F.greatest(F.size("lower"), F.lit(1))), lambda i: (held(i) == group) & (F.get("lower", i - 1) == name))
    return both.select("file", F.coalesce(F.get(fits, F.lit(0)) - 1, F.lit(fallback)).alias("at"))


def intovet(found: DataFrame) -> DataFrame:
    """SRC-01: visits of the first sheet of each workbook: two header rows and a last row of totals are left out, the amount
    stands where the header says. The rows are written once, as headers and totals are read from them too."""
    first = written(found.where("sheet = 0"))
    at = amount_positions(first.where("row_no <= 2"), INTOVET_AMOUNT)
    named = first.where("row_no > 2").join(at, "file", "left").select("file", "row_no", *(_at(i).alias(f"c{i}") for i in INTOVET.values()), F.coalesce(_at(F.coalesce("at", F.lit(INTOVET_AMOUNT))), F.lit("")).alias("c99"))
    who = [f"c{INTOVET[c]}" for c in ("customer_no", "customer_name", "patient_name")]
    return readers.positional(readers.without_totals(named, who, ["c99"]), INTOVET | {"amount": 99})


def woorien(found: DataFrame) -> DataFrame:
    """SRC-04: treatments of the first sheet of each workbook, below one header row; a last row of totals is left out.
    The rows are written once, as totals are told from them too."""
    at = readers.POSITIONS["woorien"]
    named = written(found.where("sheet = 0 and row_no > 1")).select("file", "row_no", *(_at(i).alias(f"c{i}") for i in at.values()))
    who = [f"c{at[c]}" for c in ("customer_no", "customer_name", "patient_name")]
    return readers.positional(readers.without_totals(named, who, [f"c{at['amount']}"]), at)


def _day(c: Column) -> Column:
    """A date as the dashboard writes it, with or without dots at its end; null for all else."""
    plain = F.substring(F.regexp_replace(F.replace(F.trim(c), F.lit("."), F.lit("-")), "^-+|-+$", ""), 1, 10)
    return F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}$"), plain.try_cast("date"))


def dashboard(found: DataFrame, hospital: str, account: str, customer: str) -> dict[str, DataFrame]:
    """SRC-08: the daily tables of a dashboard's first four sheets, by name: blog, place, powerlink and placead. Rows without a
    date, and ads without a campaign and a group, are left out; what is no number counts as 0. The rows are written once for all
    four."""
    found = written(found)
    whole = lambda i: F.coalesce(_at(i).try_cast("double").cast("long"), F.lit(0))
    fixed = {"hospital_id": F.lit(hospital), "metadata": F.lit("{}")}
    daily = found.where(F.col("row_no") > 1).withColumn("metric_date", _day(_at(0))).where("metric_date is not null")
    daily = daily.withColumns(fixed | {"account_id": F.lit(account), "hospital_name": F.lit("")})
    blog = daily.where("sheet = 0").select("account_id", "hospital_id", "hospital_name", "metric_date", whole(1).alias("blog_views"), whole(2).alias("blog_unique_visitors"), "metadata")
    place = daily.where("sheet = 1").select("account_id", "hospital_id", "hospital_name", "metric_date", whole(1).alias("smartplace_inflow"), "metadata")
    named = {"campaign_name": 1, "adgroup_name": 2}
    ads = found.where(F.col("row_no") > 1).withColumns({"metric_date": _day(_at(3))} | {n: F.trim(F.coalesce(_at(i), F.lit(""))) for n, i in named.items()})
    ads = ads.where("metric_date is not null and (campaign_name <> '' or adgroup_name <> '')")
    empty = lambda n: F.lit("").alias(n)

    def channel(sheet: int, payload: str) -> DataFrame:
        return ads.where(F.col("sheet") == sheet).select(
            "metric_date", F.lit(hospital).alias("hospital_id"), F.lit(customer).alias("customer_id"), empty("campaign_id"), "campaign_name", empty("adgroup_id"), "adgroup_name", empty("keyword_id"),
            whole(4).alias("impressions"), whole(5).alias("clicks"), F.coalesce(_at(8).try_cast("double"), F.lit(0.0)).alias("cost"), empty("conversions"), empty("conversion_value"), F.lit(payload).alias("raw_payload"))

    return {"blog": blog, "place": place, "powerlink": channel(2, "{}"), "placead": channel(3, '{"ad_channel":"place_ad"}')}


def write_dashboard(tables: dict[str, DataFrame], path: str) -> None:
    """SRC-08: each table as a CSV file with a byte order mark, in a folder of its name."""
    for name, rows_of in tables.items():
        readers.write_marked_csv(rows_of, f"{path.rstrip('/')}/{name}")
