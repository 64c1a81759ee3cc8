"""Column profiles, semantic types and summaries, each in one pass over the table whatever the number of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import columns as C
from tallyloom.functions.tables import exact_quartiles
from tallyloom.functions.mathx import k2, shapiro


def kinds(df: DataFrame) -> dict[str, str]:
    """Physical kind by column: whole, real, time, bool, string."""
    out = {f.name: "string" for f in df.schema}
    out |= dict.fromkeys(C.whole(df), "whole") | dict.fromkeys([c for c in C.numeric(df) if c not in C.whole(df)], "real") | dict.fromkeys(C.times(df), "time")
    return out | {f.name: "bool" for f in df.schema if f.dataType.typeName() == "boolean"}


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n): counts by value of every column from one exchange; partial counts are made before it."""
    return C.long_form(df, cols, "string").groupBy("column", "value").agg(F.count("*").alias("n"))


def profile(df: DataFrame, cols: list[str] | None = None, mode: str = "strict") -> DataFrame:
    """column, kind, n, n_missing, missing_pct, n_unique, semantic_type of each column; empty tables give no rows."""
    cols = cols or df.columns
    found = kinds(df)
    counted = value_counts(df, cols).groupBy("column").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_unique"),
    )
    kind = F.create_map(*[F.lit(x) for c in cols for x in (c, found[c])])[F.col("column")]
    typed = counted.withColumn("kind", kind)
    return typed.select("column", "kind", "n", "n_missing", F.round(C.share(F.col("n_missing"), F.col("n"), 100), 4).alias("missing_pct"), "n_unique", semantic_type(mode).alias("semantic_type"))


def semantic_type(mode: str = "strict") -> Column:
    """The semantic type from kind, n, n_missing and n_unique.

    strict wants identifiers to be whole numbers and looks at values that are there; loose takes any numeric column with
    nearly as many values as rows for one.
    """
    n, held, u, kind = F.col("n"), F.col("n") - F.col("n_missing"), F.col("n_unique"), F.col("kind")
    number = kind.isin("whole", "real")
    few = (u <= 5) | ((C.share(u, F.greatest(held, F.lit(1))) < 0.05) & (u < 20))
    text = F.when(u <= 20, "categorical").otherwise("text")
    out = F.when(held == 0, "empty").when(kind == "time", "datetime")
    if mode == "loose":
        out = out.when(kind == "string", text).when(kind == "bool", "categorical").when(number & (u > 0.95 * n) & (u > 10), "identifier")
    else:
        out = out.when((kind == "whole") & (C.share(u, held) > 0.95), "identifier").when(kind == "bool", "categorical_numeric")
    return out.when(number & few, "categorical_numeric").when((kind == "whole") & (u < 25), "ordinal").when(number, "continuous").otherwise(text)


def summary(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """Moments, quartiles and extremes of numeric columns; std, skew and kurtosis are the sample's."""
    held = C.long_form(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    out = held.groupBy("column").agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        *([] if exact else [C.quartiles(exact=False).alias("q")]),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        C.sample_skew().alias("skew"),
        C.sample_kurtosis().alias("kurtosis"),
    )
    if exact:
        out = out.join(F.broadcast(exact_quartiles(held)), "column")  # a row a column
    return out.select("column", "n", "mean", "std", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "min", "max", "skew", "kurtosis")


def modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct values, mode, its count and share of the values that are there; ties go to the least value."""
    counted = value_counts(df, cols).where(F.col("value").isNotNull())
    return counted.groupBy("column").agg(
        F.count("*").alias("n_unique"), F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("value"))).alias("top")
    ).select("column", "n_unique", F.col("top.value").alias("mode"), (-F.col("top.k")).alias("mode_n"), F.round(-F.col("top.k") * 100.0 / F.col("n"), 4).alias("mode_pct"))


def top_values(df: DataFrame, cols: list[str], k: int = 10) -> DataFrame:
    """The k most frequent values of each column."""
    counted = value_counts(df, cols).where(F.col("value").isNotNull())
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def breakdown(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """Counts of the k most frequent values and of all others together."""
    ranked = top_values(df, [col], 1 << 30)
    return ranked.groupBy(F.when(F.col("rank") <= k, F.col("value")).otherwise("other").alias("value")).agg(F.sum("n").alias("n"))


def time_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """First, last, days between and distinct values of time columns."""
    counted = C.long_form(df, cols, "timestamp").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("k"))
    return counted.groupBy("column").agg(F.sum("k").alias("n"), F.min("value").alias("first"), F.max("value").alias("last"), F.count("*").alias("n_unique")).withColumn("span_days", F.floor((F.unix_timestamp("last") - F.unix_timestamp("first")) / 86400))


def identifiers(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_unique, min, max) of identifiers, ends in the order of their values as text."""
    return value_counts(df, cols).groupBy("column").agg(F.count("*").alias("n_unique"), F.min("value").alias("min"), F.max("value").alias("max"))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins, the last one closed: bin, low, high, n. Two passes: extremes, then counts by bin."""
    value = F.col(col).cast("double")
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo IS NOT NULL")
    width = (F.col("hi") - F.col("lo")) / bins
    placed = df.select(value.alias("v")).where("v IS NOT NULL").join(F.broadcast(ends))  # one row
    number = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("long")
    return placed.groupBy(number.alias("bin"), "lo", "hi").agg(F.count("*").alias("n")).select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def normality(df: DataFrame, cols: list[str], sample: int = 5000) -> DataFrame:
    """K2 and Shapiro-Wilk by column. K2 needs aggregates alone and covers all rows; Shapiro-Wilk, which is defined for
    5000 values at most, takes those of least hash. normal: the larger p is over 0.05, the skew under 2, kurtosis under 7."""
    spark = df.sparkSession
    held = C.long_form(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    stats = {r["column"]: r for r in held.groupBy("column").agg(F.count("*").alias("n"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2")).collect()}
    rank = F.row_number().over(Window.partitionBy("column").orderBy("h", "value"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    few = df.select(F.xxhash64(*df.columns).alias("h"), F.explode(cells).alias("x")).select("h", "x.column", "x.value").where("value IS NOT NULL AND NOT isnan(value)")
    # a filter by hash keeps about twice each column's sample before rows meet for the exact rank
    share = {c: min(1 << 20, math.ceil((1 << 20) * 2 * sample / r["n"])) for c, r in stats.items()}
    shares = F.create_map(*[F.lit(x) for c, k in share.items() for x in (c, k)]) if share else F.create_map(F.lit(""), F.lit(0))
    kept = few.where(F.pmod("h", F.lit(1 << 20)) < shares[F.col("column")])
    values: dict[str, list[float]] = {}
    for r in kept.withColumn("r", rank).where(F.col("r") <= sample).select("column", "value").collect():
        values.setdefault(r["column"], []).append(r["value"])
    out = []
    for c, r in stats.items():
        if r["n"] < 8 or r["g1"] is None or math.isnan(r["g1"]):
            out.append((c, r["n"], None, None, None, None, None))
            continue
        stat, p = k2(r["g1"], r["g2"], r["n"])
        w, pw = shapiro(values[c]) if len(values.get(c, [])) >= 12 else (None, None)
        out.append((c, r["n"], stat, p, w, pw, max(p, pw or 0) > 0.05 and abs(r["g1"]) < 2 and abs(r["g2"]) < 7))
    return spark.createDataFrame(out, "column string, n long, k2 double, k2_p double, shapiro_w double, shapiro_p double, normal boolean")
