"""Workbooks: what is written comes back, types are found, and sheets of other programs' making are read."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import readers, sinks, workbook

SF = "/root/testdata/sf0.001"
MAIN, REL = workbook.MAIN, workbook.RELATIONS


def test_tables_come_back(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    workbook.write_workbooks(orders.repartition(3), str(tmp_path / "o"))
    assert len(list((tmp_path / "o").glob("part-*.xlsx"))) == 3 and not list((tmp_path / "o").glob(".part*.xlsx"))
    back = readers.read_excel(spark, str(tmp_path / "o"))
    assert back.rdd.getNumPartitions() == 3
    kinds = {f.name: f.dataType.typeName() for f in back.schema}
    assert kinds["o_orderkey"] == "long" and kinds["o_totalprice"] == "double" and kinds["o_orderdate"] == "timestamp" and kinds["o_orderstatus"] == "string"
    same = orders.select([F.col(c).cast(back.schema[c].dataType) for c in back.columns])
    assert back.exceptAll(same).count() == 0 and back.count() == orders.count()
    workbook.write_workbooks(orders.limit(5).coalesce(1), str(tmp_path / "o"))
    assert readers.read_excel(spark, str(tmp_path / "o")).count() == 5
    workbook.write_workbooks(orders.where("false"), str(tmp_path / "none"))
    assert readers.read_excel(spark, str(tmp_path / "none")).columns == orders.columns


def test_cells(spark, tmp_path):
    when = datetime.datetime(2024, 2, 29, 13, 5, 59)
    rows = [(1, 2.5, True, when, "a <b> & \"c\"\n  d"), (None, None, None, None, None), (10**17, -1e-300, False, datetime.date(1899, 1, 1), "\x01x 日本語 🙂")]
    with open(tmp_path / "a.xlsx", "wb") as f:
        workbook.write_book(f, [("one/two", ["n", "x", "b", "t", "s"], iter(rows)), ("one/two", ["n", "n"], iter([(1, "2")])), ("empty", ["q"], iter([]))])
    df = workbook.read_workbook(spark, str(tmp_path / "a.xlsx"), 0)
    assert [tuple(r) for r in df.collect()] == [("1", "2.5", "true", "2024-02-29 13:05:59", "a <b> & \"c\"\n  d"), (str(10**17), "-1e-300", "false", "1899-01-01 00:00:00", "x 日本語 🙂")]
    assert {f.name: f.dataType.typeName() for f in workbook.typed(df).schema} == {"n": "long", "x": "double", "b": "boolean", "t": "timestamp", "s": "string"}
    assert workbook.read_workbook(spark, str(tmp_path / "a.xlsx"), "one_two_").columns == ["n", "n_2"]
    assert workbook.read_workbook(spark, str(tmp_path / "a.xlsx"), "empty").count() == 0
    assert workbook.read_workbook(spark, str(tmp_path / "a.xlsx")).count() == 3  # all sheets, by name of column
    with pytest.raises(Exception, match="no sheet"):
        workbook.read_workbook(spark, str(tmp_path / "a.xlsx"), "other").count()


def test_full_sheets_go_on_in_another():
    held = io.BytesIO()
    workbook.write_book(held, [("t", ["a"], ((i,) for i in range(7)))], last_row=4)
    with zipfile.ZipFile(held) as book:
        found = workbook.sheets(book)
        assert [n for n, _ in found] == ["t", "t_2", "t_3"]
        assert [[r[0] for r in workbook.rows(book, part)] for _, part in found] == [["a", "0", "1", "2"], ["a", "3", "4", "5"], ["a", "6"]]


def test_shared_strings_gaps_and_own_formats(spark, tmp_path):
    """What other programs write: shared and rich strings, cells left out, absolute parts, an own date format, 1904 dates."""
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><workbookPr date1904="1"/><sheets><sheet name="S" sheetId="9" r:id="x7"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{workbook.PACKAGE}"><Relationship Id="x7" Type="t" Target="/xl/worksheets/w.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>name</t></si><si><r><t>Ann</t></r><r><t xml:space="preserve"> B</t></r><rPh><t>no</t></rPh></si></sst>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/w.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>day</t></is></c><c r="D1" t="str"><v>x</v></c></row><row r="2"/><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3" s="1"><v>1.5</v></c><c r="D3" s="2"><v>4</v></c><c r="AA3"><v>9</v></c></row><row r="4"><c r="D4" t="e"><v>#N/A</v></c><c r="C4" t="b"><v>0</v></c></row></sheetData></worksheet>')
    df = workbook.read_workbook(spark, str(tmp_path / "b.xlsx"))
    assert df.columns == ["name", "column_2", "day", "x"]
    assert [tuple(r) for r in df.collect()] == [("Ann B", None, "1904-01-02 12:00:00", "4"), (None, None, "false", None)]


def test_fallback_report_and_heads(spark, tmp_path):
    (tmp_path / "c.xlsx").write_text("a;b\n1;2\n")
    assert readers.read(spark, str(tmp_path / "c.xlsx")).first().asDict() == {"a": 1, "b": 2}
    sinks.to_excel({"sum": spark.range(3).selectExpr("id", "array(id, 1) AS list"), "one": spark.range(1)}, str(tmp_path / "r.xlsx"))
    assert [tuple(r) for r in readers.read_excel(spark, str(tmp_path / "r.xlsx"), "sum").collect()] == [(0, "[0, 1]"), (1, "[1, 1]"), (2, "[2, 1]")]
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "_hidden").write_bytes(b"zzz")
    (folder / "0.csv").write_bytes(b"")
    with open(folder / "1.csv", "wb") as f:
        f.write(b"a,b\n")
        f.seek(3 << 30)  # three gigabytes, of which ten thousand bytes are read
        f.write(b"\n")
    assert readers.head_of(spark, str(folder))[:4] == b"a,b\n" and len(readers.head_of(spark, str(folder / "*.csv"))) == 10_000
    with pytest.raises(FileNotFoundError):
        readers.head_of(spark, str(tmp_path / "nothing*"))
    (tmp_path / "q.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert readers.broken_lines(spark, str(tmp_path / "q.csv")) and {r.b for r in readers.read(spark, str(tmp_path / "q.csv")).collect()} == {"x\ny", "z"}
    assert readers.excluded("Is_Tmp") and readers.excluded("Keep", names={"keep"}) and not readers.excluded("price", names={"pri"})
