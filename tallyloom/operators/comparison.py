"""Do two groups of rows differ: Kolmogorov and Smirnov's test of numbers, the chi-square test of categories.

Both look at counts by value, dealt out in ranges of values or by category, so no task holds a column; a row a column
reaches the driver, for the p-value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import mathx
from tallyloom.functions.tables import running, settle


def kolmogorov_sf(x: float) -> float:
    """The chance that Kolmogorov's limit distribution exceeds x."""
    if x <= 0:
        return 1.0
    if x < 1.18:  # the other form of the series settles sooner here
        y = math.exp(-(math.pi**2) / (8 * x * x))
        return max(0.0, 1 - math.sqrt(2 * math.pi) / x * sum(y ** ((2 * k - 1) ** 2) for k in range(1, 8)))
    return min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 20)))


def _unpivot(df: DataFrame, cols: list[str], side: Column) -> DataFrame:
    held = df.select(side.alias("first"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])).alias("x")).select("first", "x.*")
    return held.where(F.col("first").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))


def ks(df: DataFrame, cols: list[str], first: Column) -> DataFrame:
    """(column, n_a, n_b, d, p) for each column: the greatest distance between the shares of rows up to a value, in rows
    where `first` is true (a) and false (b). Nulls and NaN are left out; no row where a side is empty.

    A value moves the difference of the shares by k_a / n_a - k_b / n_b; its running sum, in whole numbers over n_a n_b,
    is exact. p is that of the limit distribution.
    """
    counts = settle(_unpivot(df, cols, first).groupBy("column", "value").agg(F.count_if("first").alias("a"), F.count_if(~F.col("first")).alias("b")))
    sizes = counts.groupBy("column").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b")).where("n_a > 0 AND n_b > 0")  # a row a column
    moves = counts.join(F.broadcast(sizes), "column").withColumn("_k", F.col("a").cast("decimal(19,0)") * F.col("n_b") - F.col("b").cast("decimal(19,0)") * F.col("n_a")).select("column", "value", F.col("_k").cast("decimal(38,0)").alias("_k"))
    top = running(moves, "value", ["column"]).groupBy("column").agg(F.max(F.abs("_hi")).alias("top"))
    rows = top.join(sizes, "column").select("column", "n_a", "n_b", "top").collect()
    out = [(r["column"], r.n_a, r.n_b, d := float(r.top) / (r.n_a * r.n_b), kolmogorov_sf(d * math.sqrt(r.n_a * r.n_b / (r.n_a + r.n_b)))) for r in rows]
    return df.sparkSession.createDataFrame(out, "column string, n_a long, n_b long, d double, p double")


def chi_square(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, chi2, dof, p, n, low) for each pair of columns: Pearson's test of independence without a correction, and
    the share of cells that less than five rows are expected in. Rows with a null in a pair are left out of it; a pair
    with a constant column has no row. All pairs are counted in one pass."""
    names = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in pairs]))
    cells = settle(df.select(names.alias("c")).select("c.*").where("x IS NOT NULL AND y IS NOT NULL").groupBy("a", "b", "x", "y").agg(F.count("*").alias("o")))
    rows, columns = (cells.groupBy("a", "b", k).agg(F.sum("o").alias(n)) for k, n in (("x", "r"), ("y", "c")))
    shapes = rows.groupBy("a", "b").agg(F.count("*").alias("n_rows"), F.sum("r").alias("n")).join(columns.groupBy("a", "b").agg(F.count("*").alias("n_cols")), ["a", "b"])
    met = cells.join(rows, ["a", "b", "x"]).join(columns, ["a", "b", "y"])
    # cells without a row count only through the margins: sum (o - e)^2 / e = n (sum o^2 / (r c) - 1)
    sums = met.groupBy("a", "b").agg(F.sum(F.col("o") * F.col("o") / (F.col("r").cast("double") * F.col("c"))).alias("s"))
    few = rows.groupBy("a", "b", "r").agg(F.count("*").alias("k")).join(columns.groupBy("a", "b", "c").agg(F.count("*").alias("m")), ["a", "b"]).join(F.broadcast(shapes.select("a", "b", "n")), ["a", "b"])
    low = few.groupBy("a", "b").agg((F.sum(F.when(F.col("r").cast("double") * F.col("c") < 5.0 * F.col("n"), F.col("k") * F.col("m")).otherwise(0)) / F.sum(F.col("k") * F.col("m"))).alias("low"))
    found = sums.join(shapes, ["a", "b"]).join(low, ["a", "b"]).where("n_rows > 1 AND n_cols > 1").select("a", "b", (F.col("n") * (F.col("s") - 1)).alias("chi2"), ((F.col("n_rows") - 1) * (F.col("n_cols") - 1)).alias("dof"), "n", "low").collect()
    out = [(r.a, r.b, max(0.0, r.chi2), r.dof, mathx.chi2_sf(max(0.0, r.chi2), r.dof), r.n, r.low) for r in found]
    return df.sparkSession.createDataFrame(out, "a string, b string, chi2 double, dof long, p double, n long, low double")
