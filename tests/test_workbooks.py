"""Workbooks of other programs' making, broken files, and what is written and read back from a folder."""

import io
import zipfile
from datetime import date, datetime

from pyspark.sql import functions as F

from tidewell.sources import workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(sheets, strings="", styles="", properties="", target="worksheets/{}.xml"):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i + 7}" r:id="x{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{REL}">{properties}<sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="x{i}" Target="{target.format(n)}"/>' for i, n in enumerate(sheets)) + "</Relationships>")
        for n, rows in sheets.items():
            z.writestr(f"xl/worksheets/{n}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{strings}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")
    return made.getvalue()


STYLES = """<numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;년&quot; m&quot;월&quot;"/><numFmt numFmtId="171" formatCode="0.00&quot;days&quot;"/><numFmt numFmtId="172" formatCode="[Red]#,##0\\d"/></numFmts>
<cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="172"/></cellXfs>"""


def test_cells_of_all_kinds():
    strings = "<si><t>plain</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh sb='0' eb='1'><t>note</t></rPh></si>"
    rows = """<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="AB2" t="inlineStr"><is><t>a &amp; b</t></is></c></row><row r="3"/>
      <row r="5"><c r="A5"><v>1234.5</v></c><c r="B5" s="1"><v>45360.4375</v></c><c r="C5" s="2"><v>45360</v></c><c r="D5" s="3"><v>45360</v></c><c r="E5" s="4"><v>7</v></c><c r="F5" t="b"><v>1</v></c><c r="G5" t="str"><v>made</v></c><c r="H5" t="e"><v>#N/A</v></c><c r="I5" s="2"><v>1</v></c><c r="J5" s="2"/></row>
      <row><c><v>8</v></c><c><v>9</v></c></row>"""
    found = list(workbooks.sheet_rows(book({"one": rows}, strings, STYLES)))
    assert found[0] == (0, "one", 2, ["plain", "", "rich text", *[""] * 24, "a & b"])
    assert found[1] == (0, "one", 5, ["1234.5", "2024-03-09 10:30:00", "2024-03-09", "45360", "7", "true", "made", "#N/A", "1900-01-01", ""])
    assert found[2] == (0, "one", 6, ["8", "9"]) and len(found) == 3


def test_sheets_in_order_of_the_workbook_and_days_from_1904():
    made = book({"b": '<row r="1"><c r="A1" s="1"><v>0.5</v></c></row>', "a": '<row r="1"><c r="A1"><v>2</v></c></row>'}, styles=STYLES, properties='<workbookPr date1904="1"/>', target="/xl/worksheets/{}.xml")
    assert list(workbooks.sheet_rows(made)) == [(0, "b", 1, ["1904-01-01 12:00:00"]), (1, "a", 1, ["2"])]


def test_broken_files_give_no_rows_and_are_told(spark):
    good = book({"s": '<row r="1"><c r="A1"><v>2</v></c></row>'})
    files = spark.createDataFrame([("good", good), ("text", b"not zipped"), ("cut", good[:200]), ("empty", b""), ("xml", book({"s": '<row r="1"><c></row>'})), ("other", b"PK\x05\x06" + bytes(18))], "path string, content binary")
    assert [tuple(r) for r in workbooks.rows(files).collect()] == [("good", 0, "s", 1, ["2"])]
    assert sorted(r["path"] for r in workbooks.unreadable(files).collect()) == ["cut", "empty", "other", "text", "xml"]


def test_what_is_written_reads_back_from_a_folder(spark, tmp_path):
    at = [datetime(2024, 2, 29), datetime(2024, 1, 2, 3, 4, 5), datetime(1999, 12, 31)]
    rows = spark.createDataFrame([(f"f{k % 3}", k // 3 % 2, f"Sheet \"{k // 3 % 2}\" & <1>", k // 6 + 1, f" 글 {k}\n<&>\x01 ", at[k % 3], k - 5.5) for k in range(30)], "file string, sheet int, sheet_name string, row_no int, t string, d timestamp_ntz, n double")
    cells = F.array(workbooks.cell(F.col("t")), workbooks.cell(F.lit(None).cast("string")), workbooks.cell(F.col("d"), "date"), workbooks.cell(F.col("n"), "number"))
    for r in workbooks.packed(rows.withColumn("cells", cells)).collect():
        (tmp_path / r["path"]).with_suffix(".xlsx").write_bytes(r["content"])
    found = {(r["file"].rsplit("/", 1)[1], r["sheet"], r["row_no"]): (r["sheet_name"], r["cells"]) for r in workbooks.read(spark, f"file://{tmp_path}/*.xlsx").collect()}
    shown = {0: "2024-02-29", 1: "2024-01-02 03:04:05", 2: "1999-12-31"}
    assert found == {(f"f{k % 3}.xlsx", k // 3 % 2, k // 6 + 1): (f"Sheet \"{k // 3 % 2}\" & <1>", [f" 글 {k}\n<&> ", "", shown[k % 3], str(k - 5.5)]) for k in range(30)}


def test_amounts_stand_where_the_header_says(spark):
    head = [("a", 1, ["날짜", "청구금액", "", "기타", ""]), ("a", 2, ["", "수량", " 합계 ", "합계", ""]), ("b", 1, ["청구금액"]), ("b", 2, ["합계"]), ("c", 1, ["x"]), ("c", 2, ["", "합계"]), ("d", 1, ["청구금액"])]
    found = workbooks.amount_positions(spark.createDataFrame(head, "file string, row_no int, cells array<string>"), 70)
    assert {r["file"]: r["at"] for r in found.collect()} == {"a": 2, "b": 0, "c": 70, "d": 70}


def test_dashboard_dates(spark):
    rows = [(0, 2, ["2024.04.16.", "7.9", "x"]), (0, 3, ["2024-4-6", "1", "1"]), (0, 4, ["", "1", "1"]), (0, 5, ["2024-04-17 10:00:00"]), (2, 2, ["", "camp", "", "2024-04-16"]), (2, 3, ["", " ", "", "2024-04-16"])]
    found = workbooks.dashboard(spark.createDataFrame([("f", s, "n", k, c) for s, k, c in rows], workbooks.ROWS), "h", "a", "c")
    assert sorted((r["metric_date"], r["blog_views"], r["blog_unique_visitors"]) for r in found["blog"].collect()) == [(date(2024, 4, 16), 7, 0), (date(2024, 4, 17), 0, 0)]
    assert [(r["campaign_name"], r["cost"]) for r in found["powerlink"].collect()] == [("camp", 0.0)] and found["placead"].count() == 0
