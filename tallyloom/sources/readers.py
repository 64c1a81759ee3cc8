"""Sources: delimited text, JSON, Parquet, Excel, databases, text files; header and date clean-up."""

from __future__ import annotations

import json
import re
from pathlib import PurePosixPath
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import columns as C
from tallyloom.sources.workbook import read_workbook, typed

#: Column names that hold dates, and name parts of columns that are rarely worth reading.
DATE_NAMES = frozenset("date time datetime timestamp created_at updated_at create_time update_time order_date ship_date pay_date birth_date birthday start_date end_date start_time end_time visit_date register_date transaction_date due_date invoice_date".split())
EXCLUDED = frozenset("""tmstamp entrydt transferdt entrydate entrytime examine isdel synchronize isdelete deleted createuser updateuser createip updateip temp tmp bak
backup sys system fwdate updatedate password pwd remark memo attachment image photo picture blob guid uuid rowversion""".split())
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
ENCODINGS = ("utf-8", "gb18030", "cp1252", "latin1")


def header(df: DataFrame) -> DataFrame:
    """Trimmed column names, with line breaks and tabs as underscores."""
    return df.toDF(*[re.sub(r"[\r\n\t]", "_", c.strip("﻿ ")) for c in df.columns])


def tidy(df: DataFrame, parse_dates: bool = True) -> DataFrame:
    """Clean header, no control characters, blank strings as null, and columns named like dates as times."""
    out = header(df)
    out = out.withColumns({c: F.nullif(F.trim(F.regexp_replace(c, CONTROL, "")), F.lit("")) for c in C.strings(out)})
    return dates(out) if parse_dates else out


def dates(df: DataFrame, names: frozenset[str] | set[str] = DATE_NAMES) -> DataFrame:
    """String columns of those names as timestamps; what is no time becomes null."""
    return df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in C.strings(df) if c.lower() in names})


def excluded(name: str, words: frozenset[str] | set[str] = EXCLUDED, names: frozenset[str] | set[str] = frozenset()) -> bool:
    """A name that holds one of the words, or is one of the names; letters in either case."""
    low = name.lower()
    return low in {n.lower() for n in names} or any(w.lower() in low for w in words)


def without_excluded(df: DataFrame, words: frozenset[str] | set[str] = EXCLUDED, names: frozenset[str] | set[str] = frozenset()) -> DataFrame:
    """df without those columns; `names` is the user's own list."""
    return df.select(*[c for c in df.columns if not excluded(c, words, names)])


def sniff_encoding(head: bytes) -> str:
    """The first encoding in which the head of a file reads."""
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8"
    for e in ENCODINGS:
        try:
            head.decode(e)
        except UnicodeDecodeError as err:
            if err.reason == "unexpected end of data" and e == "utf-8":  # cut inside a character
                return e
            continue
        return e
    return "latin1"


def head_of(spark: SparkSession, path: str, size: int = 10_000) -> bytes:
    """The first bytes of a file, or of the first file of a folder or pattern, from an open stream: nothing else is read."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    waiting = sorted(fs.globStatus(at) or [], key=lambda s: s.getPath().toString(), reverse=True)
    if not waiting:
        raise FileNotFoundError(path)
    while waiting:
        status = waiting.pop()
        if status.isDirectory():
            inside = [s for s in fs.listStatus(status.getPath()) if not s.getPath().getName().startswith(("_", "."))]
            waiting += sorted(inside, key=lambda s: s.getPath().toString(), reverse=True)
        elif status.getLen() or not waiting:
            stream = fs.open(status.getPath())
            try:
                return bytes(stream.readNBytes(size))
            finally:
                stream.close()
    return b""


def broken_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field may hold a line break: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None, schema=None, parse_dates: bool = True, dropped: bool = False, multi_line: bool | None = None) -> DataFrame:
    """Delimited text with a header; fields may hold line breaks inside quotes. Lines that do not fit keep what fits and
    have nulls for the rest; dropped=True leaves them out. Files are split among tasks unless a quoted line break is in
    one, which a pass over the lines finds where multi_line does not say it. A schema saves the pass that infers one."""
    multi_line = broken_lines(spark, path) if multi_line is None else multi_line
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "DROPMALFORMED" if dropped else "PERMISSIVE").option("encoding", encoding or sniff_encoding(head_of(spark, path))).option("multiLine", multi_line).option("escape", '"')
    return tidy((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path), parse_dates)


def read_txt(spark: SparkSession, path: str, sep: str | None = None, **more) -> DataFrame:
    """Delimited text whose delimiter is the first of the usual ones that the header holds."""
    first = head_of(spark, path).split(b"\n", 1)[0].decode("latin1")
    return read_csv(spark, path, sep or next((s for s in (",", "\t", ";", "|", " ") if s in first), ","), **more)


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """An array, an object, or an object a line."""
    first = head_of(spark, path, 200).lstrip(b"\xef\xbb\xbf \r\n\t")[:1]
    reader = spark.read.option("multiLine", first == b"[")
    return tidy((reader.schema(schema) if schema else reader).json(path))


def from_json(spark: SparkSession, text: str) -> DataFrame:
    """Rows of a JSON string; single quotes are read as double ones where the text is else not JSON."""
    try:
        data = json.loads(text)
    except ValueError:
        data = json.loads(text.replace("'", '"'))
    rows = data if isinstance(data, list) else [data]
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    kind = spark.range(1).select(F.schema_of_json(F.lit(json.dumps({k: v for r in rows for k, v in r.items()})))).first()[0]
    return lines.select(F.from_json("value", kind).alias("r")).select("r.*")


def read_excel(spark: SparkSession, path: str, sheet: str | int | None = 0, parse_dates: bool = True) -> DataFrame:
    """A sheet of a workbook or of a folder of workbooks (None: all sheets), a sheet a task; columns get the type that all
    their values have. A file that is no workbook is read as delimited text."""
    if head_of(spark, path, 2) != b"PK":
        return read_txt(spark, path, parse_dates=parse_dates)
    return tidy(typed(read_workbook(spark, path, sheet)), parse_dates)


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, limit: int | None = None, order: str | None = None, **options: str) -> DataFrame:
    """A table or query of a database, names in lower case. Limits, filters and columns are pushed to it; with
    partitionColumn, lowerBound, upperBound and numPartitions it is read in parallel."""
    source = {"query": query} if query else {"dbtable": table}
    df = spark.read.format("jdbc").options(url=url, pushDownLimit="true", pushDownOffset="true", **source, **options).load()
    df = df.toDF(*[c.lower() for c in df.columns])
    return (df.orderBy(F.desc(order)) if order else df).limit(limit) if limit else df


def prune_by_type(columns: list[tuple[str, str, int | None]], exclude: set[str] = frozenset(), longest: int = 4000) -> list[str]:
    """Columns worth reading of (name, database type, length): no large objects, no very long texts, no excluded names."""
    big = {"text", "ntext", "image", "binary", "varbinary", "xml", "blob", "clob", "geography", "geometry"}
    return [n for n, t, size in columns if n not in exclude and not excluded(n) and t.lower() not in big and size != -1 and (size or 0) <= longest]


def schema_of(df: DataFrame) -> DataFrame:
    """(position, column, type, nullable) of a table."""
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, nullable boolean")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): a document a line that is not blank, of a file or a folder of *.txt."""
    return spark.read.option("pathGlobFilter", "*.txt").text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")).where(F.trim("text") != "")


READERS = {".csv": read_csv, ".txt": read_txt, ".json": read_json, ".xlsx": read_excel, ".xls": read_excel}


def read(spark: SparkSession, path: str, **more) -> DataFrame:
    """A file by its extension."""
    end = PurePosixPath(urlparse(path).path).suffix.lower()
    if end == ".parquet":
        return spark.read.parquet(path)
    if end not in READERS:
        raise ValueError(f"no reader for {end or 'a file without an extension'}")
    return READERS[end](spark, path, **more)


def read_many(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Tables by file stem; a stem that is taken gets _2, _3, ..."""
    out: dict[str, DataFrame] = {}
    for p in paths:
        stem = name = PurePosixPath(urlparse(p).path).stem
        n = 2
        while name in out:
            name, n = f"{stem}_{n}", n + 1
        out[name] = read(spark, p)
    return out


def demo(spark: SparkSession, rows: int = 5000, seed: int = 42, ids: DataFrame | None = None) -> DataFrame:
    """A sales table of made-up rows that depend on the seed and their id alone; ids (id) where they are given."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(len(names))) + 1).cast("int"))
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(1_000_000)) / 1_000_000
    base = (spark.range(rows) if ids is None else ids).select("id", F.date_add(F.lit("2023-01-01").cast("date"), (u(1) * 730).cast("int")).cast("timestamp").alias("sale_date"), pick(["books", "toys", "food", "clothes", "tools"], 2).alias("category"), pick(["north", "south", "east", "west"], 3).alias("region"), (u(4) * 100 + 50).cast("int").alias("quantity"), F.round(u(5) * 90 + 10, 2).alias("unit_price"), pick([0.0, 0.05, 0.1, 0.2], 6).alias("discount"))
    return base.withColumn("amount", F.round(F.col("quantity") * F.col("unit_price") * (1 - F.col("discount")), 2))
