"""Association between columns: correlation, Cramer's V, eta squared, and which test or method applies."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import columns as C
from tallyloom.functions import mathx
from tallyloom.functions.tables import running
from tallyloom.operators import profile as P
from tallyloom.operators import quality as Q

#: Pairs in one aggregate; more would make expressions too large to compile.
PAIRS_AT_ONCE = 100


def correlations(df: DataFrame, cols: list[str], pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(a, b, r, n) of every pair over rows where both are there. All pairs are aggregates of the same pass."""
    pairs = pairs if pairs is not None else list(combinations(cols, 2))
    out = None
    for at in range(0, len(pairs), PAIRS_AT_ONCE):
        some = pairs[at : at + PAIRS_AT_ONCE]
        cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n")) for a, b in some])
        part = df.agg(cells.alias("x")).select(F.explode("x").alias("x")).select("x.*")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], "a string, b string, r double, n long")


def high_correlations(df: DataFrame, cols: list[str], least: float = 0.7) -> DataFrame:
    out = correlations(df, cols).where(F.abs("r") >= least).withColumn("r", F.round("r", 3))
    return out.orderBy(F.desc(F.abs("r")), "a", "b")


def redundant(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairs of nearly the same content: class 1, 2, 3 from 0.99, 0.95, 0.85."""
    a = F.abs("r")
    return correlations(df, cols).withColumn("redundancy", F.when(a >= 0.99, 1).when(a >= 0.95, 2).when(a >= 0.85, 3)).where("redundancy IS NOT NULL")


def average_rank(df: DataFrame, col: str, to: str) -> DataFrame:
    """Rank with the mean rank for ties. Ranks come from counts by value, so equal values never pile up in a window; the
    running sum is over distinct values, dealt in ranges."""
    placed = running(df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.count("*").alias("_k")), "_v").withColumn(to, F.col("_hi") - (F.col("_k") - 1) / 2)
    return df.join(placed.select("_v", to), df[col] == F.col("_v"), "left").drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(rho, n): correlation of average ranks over rows where both are there."""
    held = df.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    ranked = average_rank(average_rank(held, "x", "rx"), "y", "ry")
    return ranked.agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def numeric_pairs(df: DataFrame, cols: list[str], least: float = 0.3, level: float = 0.05) -> DataFrame:
    """Pairs with a correlation over `least` whose p-value is under `level`: Pearson's where both columns look normal,
    else Spearman's; the statistic reported is Pearson's r."""
    spark = df.sparkSession
    total = df.count()
    normal = {r["column"]: bool(r["normal"]) for r in P.normality(df, cols).collect()}
    out = []
    for a, b, r, n in correlations(df, cols).where((F.abs("r") > least) & (F.col("n") >= 3)).collect():
        kind, p = "pearson", mathx.pearson_p(r, n)
        if not (normal.get(a) and normal.get(b)):
            rho = spearman(df, a, b).first()["rho"]
            kind, p = "spearman", mathx.pearson_p(rho, n)
        if p < level:
            out.append((a, b, kind, r, p, n, n / total))
    return spark.createDataFrame(out, "a string, b string, test string, r double, p double, valid_count long, confidence double")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(x, y, o, r, c, n): counts of value pairs with their margins."""
    cells = df.select(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.count("*").alias("o"))
    rows = cells.groupBy("x").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("y").agg(F.sum("o").alias("c"))
    return cells.join(rows, "x").join(cols, "y")


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, dof, v, n): Yates' correction for two by two; V over all rows of the table; no row where a column is constant."""
    t = contingency(df, a, b)
    rows = df.agg(F.count("*").alias("n_rows"))
    sums = t.agg(
        F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"), F.count_distinct("x").alias("nr"), F.count_distinct("y").alias("nc"),
        F.min("r").alias("r1"), F.max("r").alias("r2"), F.min("c").alias("c1"), F.max("c").alias("c2"), F.min(F.struct("r", "c", "o"))["o"].alias("o11"), F.min(F.struct("r", "c", "o"))["c"].alias("k11"), F.min(F.struct("r", "c", "o"))["r"].alias("q11"),
    )
    e = F.col("q11") * F.col("k11") / F.col("n")
    d = F.abs(F.col("o11") - e)
    gap = d - F.least(F.lit(0.5), d)
    n = F.col("n").cast("double")
    yates = gap * gap * n * n * n / (F.col("r1").cast("double") * F.col("r2") * F.col("c1") * F.col("c2"))
    chi2 = F.when((F.col("nr") == 2) & (F.col("nc") == 2), yates).otherwise(n * (F.col("s") - 1))
    return sums.join(rows).where("nr > 1 AND nc > 1").select(
        chi2.alias("chi2"), ((F.col("nr") - 1) * (F.col("nc") - 1)).alias("dof"), F.sqrt(chi2 / (F.col("n_rows") * (F.least("nr", "nc") - 1))).alias("v"), "n"
    )


def categorical_pairs(df: DataFrame, cols: list[str], level: float = 0.05) -> DataFrame:
    out = []
    for a, b in combinations(cols, 2):
        r = cramers_v(df, a, b).first()
        if r and (p := mathx.chi2_sf(r["chi2"], r["dof"])) < level:
            out.append((a, b, r["chi2"], r["dof"], r["v"], p, r["n"]))
    return df.sparkSession.createDataFrame(out, "a string, b string, chi2 double, dof long, v double, p double, valid_count long")


def eta_squared(df: DataFrame, group: str, value: str) -> DataFrame:
    """(eta2, n, n_groups): share of the value's variance between groups of two or more rows."""
    held = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    by = held.groupBy("g").agg(F.count("*").alias("k"), F.avg("x").alias("m"), F.sum("x").alias("s"), F.var_pop("x").alias("v"))
    total = by.agg((F.sum("s") / F.sum("k")).alias("mean"))
    every = by.join(F.broadcast(total))  # one row
    far = F.col("m") - F.col("mean")
    real = F.col("g").isNotNull() & (F.col("k") > 1)
    within = F.sum(F.col("k") * (F.col("v") + far * far))
    return every.agg((F.sum(F.when(real, F.col("k") * far * far)) / F.nullif(within, F.lit(0.0))).alias("eta2"), F.sum("k").alias("n"), F.count_if(real).alias("n_groups"))


def strength(value):
    a = F.abs(value)
    return F.when(a >= 0.7, "strong").when(a >= 0.5, "medium").when(a >= 0.3, "weak").otherwise("none")


def pair_advice(df: DataFrame, a: str, b: str) -> DataFrame:
    """Which test fits a pair of categories, and what speaks against it."""
    t = contingency(df, a, b)
    e = F.col("r") * F.col("c") / F.col("n")
    total = t.agg(F.sum("o").alias("n"))
    sums = t.join(F.broadcast(total)).groupBy("n").agg(F.count_distinct("x").alias("levels_a"), F.count_distinct("y").alias("levels_b"), F.count_if(e >= 5).alias("full"), (F.max("r") / F.max("n")).alias("top_a"), (F.max("c") / F.max("n")).alias("top_b"))
    cells = F.col("levels_a") * F.col("levels_b")
    advice = F.when((F.col("levels_a") > 50) | (F.col("levels_b") > 50), "reduce levels").when((F.col("n") < 100) | ((cells - F.col("full")) / cells > 0.2), "fisher").otherwise("chi2")
    return sums.select("n", "levels_a", "levels_b", advice.alias("advice"), (F.greatest("top_a", "top_b") > 0.9).alias("imbalanced"))


def group_test(df: DataFrame, group: str, value: str) -> dict:
    """The test that fits a number by groups: groups of three or more; Levene on the distances from group medians."""
    held = df.select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("x")).where("g IS NOT NULL AND x IS NOT NULL")
    med = held.groupBy("g").agg(F.median("x").alias("med"), F.count("*").alias("n"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2")).where("n >= 3")
    groups = med.collect()
    if len(groups) < 2:
        return {"test": None, "groups": len(groups)}
    normal = all(r["n"] < 8 or (r["g1"] == r["g1"] and mathx.k2(r["g1"], r["g2"], r["n"])[1] > 0.05) for r in groups)
    away = held.join(med.select("g", "med"), "g").select("g", F.abs(F.col("x") - F.col("med")).alias("d"))
    by = away.groupBy("g").agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.var_pop("d").alias("v")).collect()
    n = sum(r["n"] for r in by)
    mean = sum(r["n"] * r["m"] for r in by) / n
    between, within = sum(r["n"] * (r["m"] - mean) ** 2 for r in by), sum(r["n"] * r["v"] for r in by)
    k = len(by)
    levene = (between / (k - 1)) / (within / (n - k)) if within > 0 else 0.0
    p = mathx.f_sf(levene, k - 1, n - k)
    test = ("t" if p > 0.05 else "welch") if normal and k == 2 else "mann-whitney" if k == 2 else "anova" if normal and p > 0.05 else "kruskal-wallis"
    return {"test": test, "groups": k, "normal": normal, "levene": levene, "levene_p": p}


def cluster_advice(df: DataFrame, cols: list[str]) -> dict:
    n = df.count()
    share = [r["outlier_pct"] / 100 for r in Q.outliers(df, cols).collect()]
    if n < 10:
        return {"method": None, "reason": "fewer than 10 rows"}
    method = "dbscan" if np.mean(share or [0]) > 0.1 else "minibatch" if n > 10_000 else "kmeans" if n > 1000 else "hierarchical"
    return {"method": method, "pca_first": len(cols) > n / 5}


def basket_advice(df: DataFrame, cols: list[str]) -> dict:
    n = df.count()
    items = P.value_counts(df, cols).where("value IS NOT NULL").count()
    return {"method": "fp-growth" if n > 100_000 else "either" if n > 10_000 else "apriori", "prune": items > 500}


def suggested_queries(df: DataFrame, time: str | None, category: str | None, number: str | None) -> list[str]:
    """Conditions worth trying: the time range, the three commonest categories, the middle half of a number, all of them."""
    out = []
    if time:
        r = P.time_summary(df, [time]).first()
        out.append(f"{time} BETWEEN '{r['first']}' AND '{r['last']}'")
    if category:
        names = ", ".join("'" + r["value"].replace("'", "''") + "'" for r in P.top_values(df, [category], 3).orderBy("rank").collect())
        out.append(f"{category} IN ({names})")
    if number:
        r = P.summary(df, [number]).first()
        out.append(f"{number} BETWEEN {r['q1']} AND {r['q3']}")
    return [*out, " AND ".join(out)] if len(out) > 1 else out
