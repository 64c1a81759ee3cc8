"""Streams whose rows go through files, and state by key."""

import duckdb
from pyspark.sql import functions as F

from tallyloom import catalogue
from tallyloom.streaming import events as Z

SF = "/root/testdata/sf0.001"


def as_sql(spark, name, folder=SF):
    """The query's frame, after its rows were found equal to SQL's."""
    df = catalogue.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    res = con.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, res.fetchall()))
    return df


def test_sessions_pass_no_driver(spark):
    assert as_sql(spark, "z03_stream_sessions").inputFiles()  # a table in the driver's memory has none


def test_unique_events_pass_no_driver(spark):
    assert as_sql(spark, "z05_stream_once").inputFiles()


def test_the_last_of_each_key_after_several_batches(spark, tmp_path):
    for i in range(3):
        spark.range(i, 4).select("id").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    counts = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").groupBy("id").agg(F.count("*").alias("n"))
    for mode in ("update", "complete"):
        got = Z.run_to_files(counts, f"{tmp_path}/{mode}", mode, ["id"]).collect()
        assert {r.id: r.n for r in got} == {0: 1, 1: 2, 2: 3, 3: 3} and len(got) == 4
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != Z.STATE["spark.sql.streaming.stateStore.providerClass"]


def test_spikes_in_the_order_of_ids_over_all_frames(spark, tmp_path):
    """One user's rows in many frames and out of order, with rows without a value."""
    rows = "SELECT CAST((i * 7919) % 5003 AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' AS ts, CAST(CASE WHEN i = 9 THEN 2 ELSE CASE WHEN i % 40 = 38 THEN 1 ELSE 0 END END AS BIGINT) AS user_id, 'a' AS event_type, CASE WHEN i % 10 = 9 THEN NULL ELSE CAST((i * 7919) % 5003 % 97 * ((i * 7919) % 5003) AS DOUBLE) END AS value, 'x' AS props FROM range(5003) t(i)"
    duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        df = as_sql(spark, "z06_stream_spikes", str(tmp_path))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert df.inputFiles() and df.where("mean IS NULL").count() == 1


def test_spikes_go_on_after_a_batch(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(10 * i + j, 1, v) for j, v in enumerate([(1.0, 4.0, None), (2.0, 99.0, 7.0)][i])], "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    events = spark.readStream.schema("event_id long, user_id long, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    assert [tuple(r) for r in Z.run_to_files(Z.spikes(events), f"{tmp_path}/out", "update", ["user_id"]).collect()] == [(1, 6, 22.6, 2)]
