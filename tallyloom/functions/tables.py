"""Tables between steps, and exact ranks over ranges."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary folder of this machine, which all tasks
    share only if they run here: on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tallyloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: iterations keep a short lineage that survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(counts: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """counts (by, value, _k) with _hi, the rows up to and with each value, _lo, those before it, and _n, all of them. Values
    are dealt out in ranges that are written once, so they stay what they are; a range's base comes from the totals of
    those before it, a row each."""
    by = list(by)
    ranged = settle(counts.repartitionByRange(*by, value).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy(*by or [F.lit(0)])
    totals = ranged.groupBy(*by, "_p").agg(F.sum("_k").alias("_t"))
    totals = totals.withColumn("_base", F.coalesce(F.sum("_t").over(before.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_t").over(before)).drop("_t")
    inside = Window.partitionBy(*by, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(F.broadcast(totals), [*by, "_p"]).withColumn("_hi", F.col("_base") + F.sum("_k").over(inside))
    return placed.withColumn("_lo", F.col("_hi") - F.col("_k")).drop("_p", "_base")


#: Of percentile sketches: their accuracy, and how far about a quartile, as a share of the rows, exact ranks are looked for.
#: Columns of at most SMALL rows are ranked whole; of more than LARGE, over ranges.
ACCURACY, SMALL, LARGE = 20_000, 20_000, 2_000_000_000
MARGIN = 3 / ACCURACY


def _interpolated(at: DataFrame, value: str) -> DataFrame:
    """(column, q) of (column, value, _lo, _hi, _n): the values at the quartiles' places, interpolated."""
    places = [F.lit(p) * (F.col("_n") - 1) for p in (0.25, 0.5, 0.75)]
    found = lambda x: F.min(F.when((F.col("_lo") <= x) & (x < F.col("_hi")), F.col(value)))
    ends = at.groupBy("column", "_n").agg(*[found(end(x)).alias(f"{side}{i}") for i, x in enumerate(places) for side, end in (("low", F.floor), ("high", F.ceil))])
    mixed = [F.when(F.floor(x) == F.ceil(x), F.col(f"low{i}")).otherwise((F.ceil(x) - x) * F.col(f"low{i}") + (x - F.floor(x)) * F.col(f"high{i}")) for i, x in enumerate(places)]
    return ends.select("column", F.array(*mixed).alias("q"))


def ranked_quartiles(held: DataFrame) -> DataFrame:
    """As exact_quartiles, by counting and ranking all values in ranges over all tasks."""
    return _interpolated(running(held.groupBy("column", "value").agg(F.count("*").alias("_k")), "value", ["column"]), "value")


def exact_quartiles(held: DataFrame) -> DataFrame:
    """(column, q) of (column, value) without nulls: q holds lower quartile, median and upper quartile, interpolated.

    Two scans. A sketch gives values a little below and above each quartile; then rows between those are counted by
    value, and rows outside by the gap they fall in, so that partial sums leave almost nothing to shuffle, and ranks of
    the few values between are exact. Columns whose places are not between (as with NaN) are ranked whole; only a row a
    column reaches the driver.
    """
    shares = [max(0.0, p - MARGIN) for p in (0.25, 0.5, 0.75)] + [min(1.0, p + MARGIN) for p in (0.25, 0.5, 0.75)]
    sketched = held.groupBy("column").agg(F.count("*").alias("n"), F.percentile_approx("value", shares, ACCURACY).alias("at")).collect()
    spark = held.sparkSession
    large = [r["column"] for r in sketched if r.n > LARGE]
    edges = [(r["column"], r.n, [float(x) for x in r["at"]]) for r in sketched if r.n <= LARGE]
    between = spark.createDataFrame([(c, n, n <= SMALL, *x) for c, n, x in edges], "column string, _n long, _whole boolean, a0 double, a1 double, a2 double, b0 double, b1 double, b2 double")
    value = F.col("value").cast("double")
    near = F.col("_whole") | ((value >= F.col("a0")) & (value <= F.col("b0"))) | ((value >= F.col("a1")) & (value <= F.col("b1"))) | ((value >= F.col("a2")) & (value <= F.col("b2")))
    # a value between, or, of those outside, how many quartiles lie below them
    gap = F.when(value < F.col("a0"), 0).when(value < F.col("a1"), 1).when(value < F.col("a2"), 2).otherwise(3)
    edge = F.when(gap == 0, float("-inf")).when(gap == 1, F.col("b0")).when(gap == 2, F.col("b1")).otherwise(F.col("b2"))
    counts = held.join(F.broadcast(between), "column").groupBy("column", "_n", F.when(near, value).otherwise(edge).alias("_at"), near.alias("_near")).agg(F.count("*").alias("_k"), F.min(F.when(near, F.col("value"))).alias("value"))
    order = Window.partitionBy("column").orderBy("_at", F.desc("_near")).rowsBetween(Window.unboundedPreceding, 0)
    at = counts.withColumn("_hi", F.sum("_k").over(order)).withColumn("_lo", F.col("_hi") - F.col("_k"))
    out = settle(_interpolated(at, "value"))
    lost = [r["column"] for r in out.where(F.exists("q", lambda x: x.isNull())).select("column").collect()]
    if lost or large:
        out = out.where(~F.col("column").isin(lost)).unionByName(ranked_quartiles(held.where(F.col("column").isin(lost + large))))
    return out
