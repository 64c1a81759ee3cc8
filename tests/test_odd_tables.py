"""Queries against SQL on tables with odd values."""

import duckdb

from tallyloom import catalogue


def rows_as_sql(spark, name, folder, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    res = con.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in res.description]
    got = sorted(str(tuple(r[c] for c in names)) for r in catalogue.QUERIES[name](spark, str(folder)).collect())
    assert got == sorted(map(str, res.fetchall()))
    return got


def test_identifiers_are_no_sentinels(spark, tmp_path):
    rows = [(i, 7 if i % 2 else i, "a", v, p) for i, v, p in [(999999, 1.0, "x"), (9999999, -999.0, " \u00a0"), (3, 999999.0, ""), (4, None, None), (5, 2.0, "\t"), (6, 9999999.0, "y ")]]
    made = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").selectExpr("event_id", "timestamp'2024-01-01' AS ts", "user_id + 100 AS user_id", "event_type", "value", "props")
    made.write.parquet(f"{tmp_path}/events.parquet")
    assert rows_as_sql(spark, "p01_prescreen_events", tmp_path, "events") == ["(2, 3, 3)"]


def test_lines_of_other_repeated_characters_stay(spark, tmp_path):
    lines = ["a line of words that is long enough " + x for x in ("LLLLLL", "llllll", "------", "......", "######", "~~~~~~", "éééééé", "[[[[[[", "aaaaa", "      x")]
    lines += ["12345 678.90, 12345 67890", "12345 678.90, 12345 6\x0b890", "1234567890123456789012\x85", "-- -- ** !! ?? -- ** !! ??", "short " + " " * 20, "　" * 21 + "short", "0123456" + " " * 20, " " * 20 + "612345", "plain words that say something here\r"]
    rows = [(i, x) for i, x in enumerate(lines)] + [(100, "\n".join(lines)), (101, ""), (102, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_as_sql(spark, "x06_without_noise", tmp_path, "documents")
    assert any("LLLLLL" in x for x in got) and not any("llllll" in x for x in got)
