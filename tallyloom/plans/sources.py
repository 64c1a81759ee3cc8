"""Queries that write a given table in a format and read it back: what comes back is the table."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tables import shared_folder
from tallyloom.plans.registry import query
from tallyloom.session import table
from tallyloom.sources import readers as R
from tallyloom.sources import sinks as S
from tallyloom.sources import workbook as W

ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, o_orderpriority FROM orders"
EVENTS = "SELECT event_id, user_id, event_type, value FROM events"


def fresh(s, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def as_orders(df: DataFrame) -> DataFrame:
    return df.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus", F.col("o_totalprice").cast("double"), F.col("o_orderdate").cast("timestamp_ntz"), "o_orderpriority")


def plain_orders(s, d) -> DataFrame:
    return table(s, d, "orders").withColumns({"o_totalprice": F.col("o_totalprice").cast("double"), "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")})


@query("s01_csv", ORDERS)
def _(s, d):
    path = fresh(s, "csv")
    plain_orders(s, d).write.option("header", True).csv(path)
    return as_orders(R.read_csv(s, path))


@query("s04_delimited", ORDERS)
def _(s, d):
    path = fresh(s, "txt")
    plain_orders(s, d).write.option("header", True).option("sep", "|").csv(path)
    return as_orders(R.read_txt(s, path))


@query("s02_excel", ORDERS)
def _(s, d):
    path = fresh(s, "xlsx")
    W.write_workbooks(plain_orders(s, d), path)
    return as_orders(R.read_excel(s, path, None))


@query("s03_json_lines", EVENTS)
def _(s, d):
    path = fresh(s, "json")
    table(s, d, "events").select("event_id", "user_id", "event_type", "value").write.json(path)
    return R.read_json(s, path).select(F.col("event_id").cast("long"), F.col("user_id").cast("long"), "event_type", F.col("value").cast("double"))


@query("k01_parquet", EVENTS)
def _(s, d):
    path = fresh(s, "events") + ".parquet"
    S.write_parquet(table(s, d, "events").select("event_id", "user_id", "event_type", "value"), path)
    return R.read(s, path)


@query("s16_documents", "SELECT CAST(unnest(list_filter(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: trim(x) <> '')) AS VARCHAR) AS text FROM documents")
def _(s, d):
    """A document for each line of text that is not blank."""
    path = fresh(s, "lines")
    table(s, d, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    return R.read_documents(s, f"{path}/*.txt").select("text")


@query("k08_text_versions", "SELECT count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS t FROM documents WHERE text IS NOT NULL AND text <> '')")
def _(s, d):
    path = fresh(s, "dump")
    S.write_text(table(s, d, "documents").where("text IS NOT NULL AND text <> ''"), "text", path)
    return s.read.text(path).agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


@query("k09_row_stream", "SELECT 'meta' AS kind, 0::BIGINT AS n UNION ALL SELECT 'data', CAST(count(*) AS BIGINT) FROM customer UNION ALL SELECT 'complete', CAST(count(*) AS BIGINT) FROM customer")
def _(s, d):
    """The lines of a stream of all customers, by kind, and the rows they tell of."""
    told: dict[str, int] = {}
    for line in S.stream_rows(table(s, d, "customer")):
        m = json.loads(line)
        told[m["type"]] = told.get(m["type"], 0) + (len(m["rows"]) if m["type"] == "data" else m.get("rows", 0))
    return s.createDataFrame(list(told.items()), "kind string, n long")
