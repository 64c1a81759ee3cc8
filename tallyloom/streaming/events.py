"""Streaming twins of batch operators: each takes a streaming or a batch DataFrame and gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def daily(events: DataFrame, time: str = "ts", value: str = "value", late: str = "1 day") -> DataFrame:
    """Counts, sums and missing values by tumbling day."""
    w = events.withWatermark(time, late).groupBy(F.window(time, "1 day")).agg(F.count("*").alias("n"), F.count(value).alias("n_value"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("day"), "n", "n_value", "total")


def sliding_mean(events: DataFrame, time: str = "ts", value: str = "value", width: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    w = events.withWatermark(time, late).groupBy(F.window(time, width, step)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return w.select(F.col("window.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    w = events.withWatermark(time, late).groupBy(user, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return w.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def alerts(events: DataFrame, condition: str, columns: list[str]) -> DataFrame:
    """Rows that break a condition; stateless."""
    return events.where(f"NOT ({condition})").select(*columns)


def once(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 day") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def run_to(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there into Parquet, then stops."""
    df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path).awaitTermination()


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there into a table of the driver's memory, for small results and tests."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


#: State by key is kept by RocksDB: in files, with a bounded part of it in an executor's memory.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def run_to_files(df: DataFrame, path: str, mode: str = "append", key: list[str] = ()) -> DataFrame:
    """Runs a stream over all that is there into Parquet files below path, which tasks write and read, and gives its rows:
    all of mode append, those after the last batch of mode complete, the last of each key of mode update."""
    spark = df.sparkSession
    rows, checkpoint, done = f"{path}/rows", f"{path}/checkpoint", []

    def put(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch={i}")
        done.append(i)

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        if mode == "append":
            run_to(df, rows, checkpoint)
        else:
            df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    read = spark.read.schema(df.schema)
    if mode == "append":
        return read.parquet(rows)
    if not done:
        return spark.createDataFrame([], df.schema)
    if mode == "complete" or len(done) == 1:
        return read.parquet(f"{rows}/batch={max(done)}")
    parts = [read.parquet(f"{rows}/batch={i}").withColumn("_batch", F.lit(i)) for i in done]
    last = reduce(DataFrame.unionByName, parts).groupBy(*key).agg(F.max_by(F.struct(*df.columns), "_batch").alias("x"))
    return last.select("x.*")


def spikes(events: DataFrame, user: str = "user_id", value: str = "value", factor: float = 3.0) -> DataFrame:
    """(user_id, n, mean, n_spikes) by user after each batch: values over `factor` times the user's running mean so far, in
    the order of event_id within a batch, however its rows are cut into frames. Rows without a value count in n alone.
    The state is counts, a sum and the spikes of each user."""
    import numpy as np
    import pandas as pd

    def step(key, frames, state):
        n, seen, total, hits = state.get if state.exists else (0, 0, 0.0, 0)
        at, v, there = (np.concatenate(x) for x in zip(*((pdf["at"].to_numpy(), pdf["v"].to_numpy(), pdf["there"].to_numpy()) for pdf in frames), strict=True))
        n += len(at)
        v = v[there][np.argsort(at[there], kind="stable")]
        if len(v):
            sums = np.cumsum(np.r_[total, v])
            before, counts = sums[:-1], np.arange(seen, seen + len(v))
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = before / counts
            # not a number is over all numbers, as in SQL
            hits += int(((counts > 0) & ((v > factor * mean) | (np.isnan(v) & ~np.isnan(mean)))).sum())
            seen, total = seen + len(v), float(sums[-1])
        state.update((n, seen, total, hits))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "seen": [seen], "total": [total], "n_spikes": [hits]})

    held = events.select(F.col(user).alias("user_id"), F.col(value).cast("double").alias("v"), F.col(value).isNotNull().alias("there"), F.coalesce("event_id", F.lit((1 << 63) - 1)).alias("at"))
    out = held.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, seen long, total double, n_spikes long", "n long, seen long, total double, hits long", "update", "NoTimeout")
    return out.select("user_id", "n", F.when(F.col("seen") > 0, F.coalesce("total", F.lit(float("nan"))) / F.col("seen")).alias("mean"), "n_spikes")
