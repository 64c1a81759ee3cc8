"""Spreadsheet workbooks (.xlsx) as a data source: a sheet of a file is a partition, read as a stream of its XML; a task
writes a workbook of its own.

A workbook is a zip of XML parts: sheet names and their parts, strings shared by all sheets, styles that tell dates from
numbers, and cells by reference (`B7`). Rows are read one after another; only a sheet's shared strings are held. Cells come
as text: numbers as written, dates as `yyyy-MM-dd HH:mm:ss`, truth values as true and false; `typed` finds the columns'
types afterwards. Files are opened by path or by a URI that Arrow knows.

Defined cases: empty cells and cells that a row leaves out are null; rows with more cells than the header are cut to it; an
empty sheet has no rows; a sheet whose columns are not those of the first one is read by name, what it lacks is null.
"""

from __future__ import annotations

import datetime
import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import urlparse
from xml.etree import ElementTree as XML
from xml.sax.saxutils import escape

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import DataType, StringType, StructField, StructType

#: Numbers of the built-in date and time formats, and the last row a sheet can have.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
LAST_ROW = 1_048_576
EPOCH = datetime.datetime(1899, 12, 30)
#: The greatest whole number a cell holds exactly; greater ones are written as text.
EXACT = 10**15
NAME = "workbook"


def _files(path: str) -> tuple[pafs.FileSystem, list[str]]:
    """The .xlsx file of that path, or those of the folder."""
    scheme = urlparse(path).scheme
    fs, root = pafs.FileSystem.from_uri(path) if scheme else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.Directory:
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        return fs, sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(".xlsx") and not f.base_name.startswith((".", "_", "~")))
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return fs, [root]


@contextmanager
def _book(fs: pafs.FileSystem, path: str) -> Iterator[zipfile.ZipFile]:
    with fs.open_input_file(path) as f, zipfile.ZipFile(f) as book:
        yield book


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet, in order."""
    targets = {r.get("Id"): r.get("Target") for r in XML.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in XML.fromstring(book.read("xl/workbook.xml")).iter():
        if _plain(s.tag) == "sheet":
            to = targets[next(v for k, v in s.attrib.items() if _plain(k) == "id" and k != "id")]
            out.append((s.get("name"), to.lstrip("/") if to.startswith("/") else f"xl/{to}"))
    return out


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out: list[str] = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in XML.iterparse(f):
            if _plain(e.tag) == "si":
                out.append(_text(e))
                e.clear()
    return out


def _text(e: XML.Element) -> str:
    """An entry's text, without its phonetic notes."""
    if _plain(e.tag) == "rPh":
        return ""
    return (e.text or "") if _plain(e.tag) == "t" else "".join(map(_text, e))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates or times."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = XML.fromstring(book.read("xl/styles.xml"))
    own = {int(e.get("numFmtId")) for e in root.iter() if _plain(e.tag) == "numFmt" and re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode") or ""), re.IGNORECASE)}
    cells = next((e for e in root if _plain(e.tag) == "cellXfs"), [])
    return {i for i, e in enumerate(cells) if int(e.get("numFmtId") or 0) in DATE_FORMATS | own}


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _when(serial: float, from_1904: bool) -> str:
    start = datetime.datetime(1904, 1, 1) if from_1904 else EPOCH
    return (start + datetime.timedelta(seconds=round(serial * 86400))).strftime("%Y-%m-%d %H:%M:%S")


def rows(book: zipfile.ZipFile, part: str) -> Iterator[list[str | None]]:
    """The rows of a sheet that hold anything, cells by place."""
    shared, dated = _strings(book), _date_styles(book)
    from_1904 = re.search(rb'date1904="(1|true)"', book.read("xl/workbook.xml")) is not None
    with book.open(part) as f:
        for _, e in XML.iterparse(f):
            if _plain(e.tag) != "row":
                continue
            out: list[str | None] = []
            for k, c in enumerate(e):
                at = _column(c.get("r")) if c.get("r") else k
                kind = c.get("t") or "n"
                value = next((x.text for x in c if _plain(x.tag) == "v"), None)
                if kind == "inlineStr":
                    value = "".join(_text(x) for x in c if _plain(x.tag) == "is")
                elif value is not None:
                    if kind == "s":
                        value = shared[int(value)]
                    elif kind == "b":
                        value = "true" if value == "1" else "false"
                    elif kind == "e":
                        value = None
                    elif kind == "n" and int(c.get("s") or 0) in dated:
                        value = _when(float(value), from_1904)
                out += [None] * (at + 1 - len(out))
                out[at] = value if value != "" else None
            e.clear()
            if any(v is not None for v in out):
                yield out


def names_of(head: list[str | None]) -> list[str]:
    """Column names of a header row: blank ones are numbered, repeated ones get _2, _3, ..."""
    out: list[str] = []
    for i, h in enumerate(head):
        name = re.sub(r"[\r\n\t]", "_", (h or "").strip()) or f"column_{i + 1}"
        n, base = 2, name
        while name.lower() in {o.lower() for o in out}:
            name, n = f"{base}_{n}", n + 1
        out.append(name)
    return out


@dataclass
class Sheet(InputPartition):
    file: str
    part: str
    name: str


class Workbook(DataSource):
    """Options: path; sheet, a name or a number from 0 (all sheets where it is not given)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _sheets(self) -> list[Sheet]:
        fs, files = _files(self.options["path"])
        want = self.options.get("sheet")
        out = []
        for file in files:
            with _book(fs, file) as book:
                found = sheets(book)
            picked = [s for i, s in enumerate(found) if want is None or s[0] == want or (want.isdigit() and int(want) == i)]
            if not picked:
                raise ValueError(f"no sheet {want} in {file}")
            out += [Sheet(file, part, name) for name, part in picked]
        return out

    def schema(self) -> StructType:
        fs, _ = _files(self.options["path"])
        for s in self._sheets():
            with _book(fs, s.file) as book:
                if head := next(rows(book, s.part), None):
                    return StructType([StructField(n, StringType()) for n in names_of(head)])
        return StructType([StructField("column_1", StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SheetReader(self.options["path"], self._sheets(), [f.name for f in schema])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PartWriter(self.options["path"], schema, overwrite)


class SheetReader(DataSourceReader):
    def __init__(self, path: str, parts: list[Sheet], columns: list[str]):
        self.path, self.parts, self.columns = path, parts, columns

    def partitions(self) -> list[Sheet]:
        return self.parts

    def read(self, partition: Sheet) -> Iterator[tuple]:
        scheme = urlparse(self.path).scheme
        fs = pafs.FileSystem.from_uri(self.path)[0] if scheme else pafs.LocalFileSystem()
        with _book(fs, partition.file) as book:
            found = rows(book, partition.part)
            head = next(found, None)
            if head is None:
                return
            at = {n: i for i, n in enumerate(names_of(head))}
            order = [at.get(c) for c in self.columns]
            for r in found:
                yield tuple(r[i] if i is not None and i < len(r) else None for i in order)


# ---- writing

TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{}</Types>'
SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet{}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
MAIN, RELATIONS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
#: Style 1 shows a date and time.
STYLES = f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>'


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int) and abs(value) < EXACT or isinstance(value, float) and abs(value) < float("inf"):
        return f"<c><v>{value!r}</v></c>"
    if isinstance(value, datetime.datetime | datetime.date):
        at = value if isinstance(value, datetime.datetime) else datetime.datetime.combine(value, datetime.time())
        if at.year >= 1901 and not at.microsecond:
            return f'<c s="1"><v>{(at.replace(tzinfo=None) - EPOCH) / datetime.timedelta(days=1)!r}</v></c>'
        value = at.isoformat(" ")
    clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]", "", str(value)).replace("\r", "\n")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def write_book(target, tables: list[tuple[str, list[str], Iterator]], last_row: int = LAST_ROW) -> None:
    """Writes (name, columns, rows) as sheets to a file object; a table of more rows than a sheet holds goes on in another."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as book:
        made: list[str] = []
        for name, columns, data in tables:
            data, more, part = iter(data), True, 1
            held = next(data, None)
            while more:
                base = re.sub(r"[\[\]:*?/\\]", "_", name)[:24] or "sheet"
                label = base if part == 1 else f"{base}_{part}"
                while label.lower() in {m.lower() for m in made}:
                    label += "_"
                made.append(label)
                with book.open(f"xl/worksheets/sheet{len(made)}.xml", "w", force_zip64=True) as f:
                    f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
                    f.write(f"<row>{''.join(map(_cell, columns))}</row>".encode())
                    n = 1
                    while held is not None and n < last_row:
                        f.write(f"<row>{''.join(map(_cell, held))}</row>".encode())
                        held, n = next(data, None), n + 1
                    f.write(b"</sheetData></worksheet>")
                more, part = held is not None, part + 1
        if not made:
            raise ValueError("a workbook has a sheet at least")
        book.writestr("[Content_Types].xml", TYPES.format("".join(SHEET_TYPE.format(i + 1) for i in range(len(made)))))
        book.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}"><Relationship Id="r1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>{"".join(f"""<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="r{i + 1}"/>""" for i, n in enumerate(made))}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}">{"".join(f"""<Relationship Id="r{i + 1}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>""" for i in range(len(made)))}<Relationship Id="rs" Type="{RELATIONS}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/styles.xml", STYLES)


@dataclass
class Written(WriterCommitMessage):
    part: str
    final: str


class PartWriter(DataSourceWriter):
    """A workbook a task; files get their names when all tasks are done, so a repeated task leaves nothing behind."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite

    def _place(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if urlparse(self.path).scheme else (pafs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        fs, root = self._place()
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        final = f"{root}/part-{task.partitionId():05d}.xlsx"
        part = f"{root}/.part-{task.partitionId():05d}-{task.taskAttemptId()}"
        with fs.open_output_stream(part) as f:
            write_book(_Counted(f), [("data", [c.name for c in self.schema], (tuple(r) for r in iterator))])
        return Written(part, final)

    def commit(self, messages: list) -> None:
        fs, root = self._place()
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if f.base_name.startswith("part-") and f.base_name.endswith(".xlsx"):
                    fs.delete_file(f.path)
        for m in messages:
            fs.move(m.part, m.final)

    def abort(self, messages: list) -> None:
        fs, _ = self._place()
        for m in messages:
            if m and fs.get_file_info(m.part).type == pafs.FileType.File:
                fs.delete_file(m.part)


class _Counted:
    """What zipfile needs of a stream that only goes forward."""

    def __init__(self, f):
        self.f, self.at = f, 0

    def write(self, data) -> int:
        self.f.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        self.f.flush()

    def seekable(self) -> bool:
        return False


def typed(df: DataFrame) -> DataFrame:
    """String columns whose values are all whole numbers, numbers, times or truth values as those; one pass."""
    kinds: list[tuple[str, str]] = [("long", "bigint"), ("double", "double"), ("boolean", "boolean"), ("timestamp", "timestamp")]
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    if not texts:
        return df
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    plain = {"long": r"rlike '^[+-]?\\d{1,18}$'", "double": "is not null", "boolean": "rlike '^(true|false)$'", "timestamp": r"rlike '^\\d{4}-\\d{2}-\\d{2}'"}
    r = df.agg(*[F.expr(f"count({quoted(c)}) > 0 AND bool_and({quoted(c)} IS NULL OR (try_cast({quoted(c)} AS {t}) IS NOT NULL AND {quoted(c)} {plain[k]}))").alias(f"{i}_{k}") for i, c in enumerate(texts) for k, t in kinds]).first()
    found: dict[str, str | DataType] = {}
    for i, c in enumerate(texts):
        if kind := next((t for k, t in kinds if r[f"{i}_{k}"]), None):
            found[c] = kind
    return df.withColumns({c: F.col(quoted(c)).cast(t) for c, t in found.items()})


def read_workbook(spark: SparkSession, path: str, sheet: str | int | None = None, schema: str | StructType | None = None) -> DataFrame:
    """Cells as text, by the header of the first sheet; typed() and a schema's types are the caller's."""
    spark.dataSource.register(Workbook)
    reader = spark.read.format(NAME)
    if sheet is not None:
        reader = reader.option("sheet", str(sheet))
    return (reader.schema(schema) if schema else reader).load(path)


def write_workbooks(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """A workbook a partition of df, in a folder."""
    df.sparkSession.dataSource.register(Workbook)
    df.write.format(NAME).mode("overwrite" if overwrite else "append").save(path)
