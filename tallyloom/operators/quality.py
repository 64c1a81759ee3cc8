"""Data quality: missing values, outliers, duplicates, validity, and the score in five dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import columns as C
from tallyloom.functions.tables import exact_quartiles
from tallyloom.operators import profile as P

WEIGHTS = {"completeness": 0.25, "accuracy": 0.25, "consistency": 0.20, "timeliness": 0.15, "uniqueness": 0.15}


def prescreen(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Blank strings and numbers that stand for missing values become null; of the given columns, or of all. Identifiers
    are best left out: among many, some are such numbers by right."""
    some = df.select(*cols) if cols else df
    out = {c: F.nullif(C.trimmed(c), F.lit("")) for c in C.strings(some)}
    out |= {c: F.when(~F.col(c).isin(*C.SENTINELS), F.col(c)) for c in C.numeric(some)}
    return df.withColumns(out)


def prescreen_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, n_blank, n_sentinel) of what prescreen takes away, in one pass."""
    some = df.select(*cols) if cols else df
    cells = [F.struct(F.lit(c).alias("column"), (C.trimmed(c) == "").alias("blank"), F.lit(False).alias("sentinel")) for c in C.strings(some)]
    cells += [F.struct(F.lit(c).alias("column"), F.lit(False).alias("blank"), F.col(c).isin(*C.SENTINELS).alias("sentinel")) for c in C.numeric(some)]
    flat = some.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    return flat.groupBy("column").agg(F.count_if("blank").alias("n_blank"), F.count_if("sentinel").alias("n_sentinel"))


def missing(df: DataFrame) -> DataFrame:
    """Columns with missing values, most missing first."""
    out = P.profile(df).where("n_missing > 0").select("column", "n_missing", "missing_pct")
    return out.orderBy(F.desc("missing_pct"), "column")


def bounds(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """Outlier bounds by column: 1.5 interquartile ranges beyond the quartiles; columns without spread are left out."""
    held = C.long_form(df, cols).where(F.col("value").isNotNull())
    if exact:
        q = held.groupBy("column").agg(F.count("*").alias("n")).join(F.broadcast(exact_quartiles(held)), "column")  # a row a column
    else:
        q = held.groupBy("column").agg(F.count("*").alias("n"), C.quartiles(exact=False).alias("q"))
    iqr = F.col("q")[2] - F.col("q")[0]
    return q.where(iqr > 0).select("column", "n", (F.col("q")[0] - 1.5 * iqr).alias("low"), (F.col("q")[2] + 1.5 * iqr).alias("high"), iqr.alias("iqr"))


def beyond(value: str = "value") -> Column:
    return (F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))


def outliers(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """Outliers by column: count and share of values that are there. A pass for the bounds and one for the counts."""
    found = bounds(df, cols, exact)
    cells = C.long_form(df, cols).where("value IS NOT NULL").join(F.broadcast(found), "column")  # a row a column
    return cells.groupBy("column", "low", "high", "n").agg(F.count_if(beyond()).alias("n_outliers")).withColumn("outlier_pct", F.col("n_outliers") * 100.0 / F.col("n"))


def outlier_rows(df: DataFrame, cols: list[str], key: list[str], per_column: int = 100) -> DataFrame:
    """The rows farthest out, by column, in interquartile ranges beyond the nearer bound, with a severity."""
    found = F.broadcast(bounds(df, cols))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    flat = df.select(*key, F.explode(cells).alias("x")).select(*key, "x.column", "x.value").join(found, "column").where(beyond())
    far = flat.withColumn("deviation", F.when(F.col("value") > F.col("high"), F.col("value") - F.col("high")).otherwise(F.col("low") - F.col("value")) / F.col("iqr"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("deviation"), *key))
    severity = F.when(F.col("deviation") > 10, "high").when(F.col("deviation") > 3, "medium").otherwise("low")
    return far.withColumn("rank", rank).where(F.col("rank") <= per_column).withColumn("severity", severity).drop("n", "low", "high", "iqr")


def duplicates(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """n, distinct, n_members (rows that share their key with another) and n_extra (all but one of each). With keys,
    rows with a null key are left out; without, all columns are compared and nulls are equal."""
    held = df.na.drop(subset=keys) if keys else df
    groups = held.groupBy(*(keys or df.columns)).agg(F.count("*").alias("k"))
    return groups.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.count("*").alias("n_distinct"),
        F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("n_members"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n_extra"),
    )


def duplicate_rows(df: DataFrame, order: list[str], limit: int = 200) -> DataFrame:
    """Rows that occur more than once, with the size of their group."""
    group = Window.partitionBy(*df.columns)
    return df.withColumn("copies", F.count("*").over(group)).where("copies > 1").orderBy(*order).limit(limit)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def auto_clean(df: DataFrame, order: list[str], ids: list[str] | None = None, most_missing: float = 80.0) -> DataFrame:
    """Columns that are nearly all missing go, then later rows of equal ids, or of equal rows."""
    gone = [r["column"] for r in missing(df).where(F.col("missing_pct") > most_missing).collect()]
    kept = df.drop(*gone)
    return keep_first(kept, [c for c in ids or kept.columns if c in kept.columns], [c for c in order if c in kept.columns])


def castable(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """How many values of each string column read as numbers and as times: the typed sense of mixed types."""
    held = C.long_form(df, cols or C.strings(df), "string").where("value IS NOT NULL")
    return held.groupBy("column").agg(F.count("*").alias("n"), F.count(F.expr("try_cast(value AS DOUBLE)")).alias("n_number"), F.count(F.expr("try_cast(value AS TIMESTAMP)")).alias("n_time"))


def invalid(df: DataFrame, as_of: str) -> DataFrame:
    """Infinite numbers and times after as_of, by column."""
    cells = [F.struct(F.lit(c).alias("column"), F.lit("infinite").alias("reason"), F.col(c).cast("double").isin(float("inf"), float("-inf")).alias("hit")) for c in C.numeric(df)]
    cells += [F.struct(F.lit(c).alias("column"), F.lit("future").alias("reason"), (F.col(c) > F.lit(as_of).cast("timestamp")).alias("hit")) for c in C.times(df)]
    flat = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    return flat.groupBy("column", "reason").agg(F.count_if("hit").alias("n_invalid"))


def suggestions(df: DataFrame, cols: list[str]) -> DataFrame:
    """What to do about missing values, outliers and duplicates: (subject, action)."""
    gaps = missing(df).withColumn("action", F.when(F.col("missing_pct") > 80, "drop column").when(F.col("missing_pct") > 50, "check source").when(F.col("missing_pct") > 20, "fill"))
    far = outliers(df, cols).where("outlier_pct > 10").withColumn("action", F.lit("check outliers"))
    twice = duplicates(df).where("n_extra > 0").select(F.lit("rows").alias("subject"), F.lit("remove duplicates").alias("action"))
    return gaps.where("action IS NOT NULL").select(F.col("column").alias("subject"), "action").unionByName(far.select(F.col("column").alias("subject"), "action")).unionByName(twice)


def imbalanced(df: DataFrame, cols: list[str], most: float = 0.8) -> DataFrame:
    """Columns whose most frequent value holds so large a share of all rows; nulls count as rows only."""
    counted = P.value_counts(df, cols)
    top = counted.groupBy("column").agg(F.sum("n").alias("n"), F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("top_n"))
    return top.withColumn("share", F.col("top_n") / F.col("n")).where(F.col("share") >= most)


def completeness(df: DataFrame) -> Column:
    """Mean over columns of the share of values that are there, as an aggregate."""
    parts = [C.share(F.count(c), F.count("*")) for c in df.columns]
    return sum(parts[1:], parts[0]) / F.lit(len(parts))


def accuracy(df: DataFrame, cols: list[str]) -> DataFrame:
    """(accuracy): one less the mean share of outliers over continuous columns; columns without spread count as right."""
    if not cols:
        return df.sparkSession.createDataFrame([(1.0,)], "accuracy double")
    return outliers(df, cols).agg((1 - F.coalesce(F.sum(C.share(F.col("n_outliers"), F.col("n"))), F.lit(0.0)) / len(cols)).alias("accuracy"))


def timeliness(last: Column, as_of: str) -> Column:
    """1 within a day of as_of, then falling; 0.8 where there is no time."""
    days = F.greatest(F.datediff(F.lit(as_of).cast("timestamp"), last), F.lit(0)).cast("double")
    late = F.greatest(F.lit(0.0), 0.5 - (days - 7) / 30)
    return F.when(last.isNull(), 0.8).when(days <= 1, 1.0).when(days <= 7, 1 - days / 7 * 0.5).otherwise(late)


def consistency(df: DataFrame, rules: list[str]) -> DataFrame:
    """(consistency): mean share of rows that keep each rule, a boolean expression; all rules in one pass."""
    if not rules:
        return df.sparkSession.createDataFrame([(1.0,)], "consistency double")
    parts = [F.coalesce(C.share(F.count_if(F.expr(r)), F.count(F.expr(r))), F.lit(1.0)) for r in rules]
    return df.agg((reduce(lambda a, b: a + b, parts) / len(parts)).alias("consistency"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 80, "good").when(score >= 70, "fair").when(score >= 60, "poor").otherwise("bad")


def score(df: DataFrame, continuous: list[str], time: str | None, as_of: str, rules: list[str] = (), ids: list[str] | None = None) -> DataFrame:
    """The five dimensions, the weighted score in per cent to one place, and its grade; one row."""
    last = F.max(time) if time else F.lit(None).cast("timestamp")
    base = df.agg(completeness(df).alias("completeness"), timeliness(last, as_of).alias("timeliness"))
    unique = duplicates(df, ids).select((1 - F.coalesce(C.share(F.col("n_extra"), F.col("n")), F.lit(0.0))).alias("uniqueness"))
    parts = base.join(accuracy(df, continuous)).join(consistency(df, list(rules))).join(unique)  # one row each
    total = F.round(100 * sum(F.col(k) * w for k, w in WEIGHTS.items()), 1)
    return parts.withColumn("score", total).withColumn("grade", grade(F.col("score")))


def field_scores(df: DataFrame, continuous: list[str]) -> DataFrame:
    """Completeness and accuracy of each column in per cent; columns of three values or fewer are left out."""
    base = P.profile(df).where(F.col("n") - F.col("n_missing") > 3).select("column", (100 - F.col("missing_pct")).alias("completeness_pct"))
    far = outliers(df, continuous).select("column", (100 - F.col("outlier_pct")).alias("accuracy_pct"))
    return base.join(F.broadcast(far), "column", "left")


def alerts(scored: DataFrame, fields: DataFrame, limit: int = 10) -> DataFrame:
    """(level, subject, value): dimensions under 0.6 and 0.8, fields under 50 and 60 per cent; errors first."""
    flat = scored.select(F.explode(F.array(*[F.struct(F.lit(k).alias("subject"), F.col(k).alias("value")) for k in WEIGHTS])).alias("x")).select("x.*")
    first = flat.withColumn("level", F.when(F.col("value") < 0.6, "error").when(F.col("value") < 0.8, "warning"))
    second = fields.where("completeness_pct < 50").select(F.col("column").alias("subject"), F.col("completeness_pct").alias("value"), F.lit("error").alias("level"))
    third = fields.where("accuracy_pct < 60").select(F.col("column").alias("subject"), F.col("accuracy_pct").alias("value"), F.lit("warning").alias("level"))
    return first.where("level IS NOT NULL").unionByName(second).unionByName(third).orderBy("level", "value", "subject").limit(limit)


def concentration(df: DataFrame, cols: list[str], top: int = 5) -> DataFrame:
    """Herfindahl index and share of the four largest values by column; nearly unique columns are left out."""
    counted = P.value_counts(df, cols).where("value IS NOT NULL")
    by_col = Window.partitionBy("column")
    total = counted.groupBy("column").agg(F.sum("n").alias("total"), F.count("*").alias("n_unique"))
    placed = counted.join(F.broadcast(total), "column").withColumn("share", F.col("n") / F.col("total"))
    hhi = placed.groupBy("column", "total", "n_unique").agg(F.sum(F.col("share") * F.col("share")).alias("hhi"))
    cr4 = placed.withColumn("r", F.row_number().over(by_col.orderBy(F.desc("n"), "value"))).where("r <= 4").groupBy("column").agg(F.sum("share").alias("cr4"))
    level = F.when(F.col("hhi") > 0.25, "high").when(F.col("hhi") > 0.15, "moderate").otherwise("low")
    return hhi.where(F.col("n_unique") <= 0.9 * F.col("total")).join(cr4, "column").withColumn("level", level)


def missing_patterns(df: DataFrame, key: str, fields: list[str], rows: int = 200) -> DataFrame:
    """The missing fields of rows that miss any, for the rows of least hash."""
    gaps = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in fields]))
    return df.select(key, gaps.alias("missing")).where(F.size("missing") > 0).orderBy(F.xxhash64(key), key).limit(rows)
