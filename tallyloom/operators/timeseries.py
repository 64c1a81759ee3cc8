"""Time series: building, ordered windows, diagnostics, trends and forecasts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import columns as C
from tallyloom.functions import mathx


def series(df: DataFrame, time: str, value: str, entity: str | None = None, unit: str = "day") -> DataFrame:
    """(entity, date, value): the mean by period, and by entity where one is named."""
    keys = [F.col(entity).alias("entity")] if entity else [F.lit("").alias("entity")]
    return df.where(F.col(time).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, F.date_trunc(unit, time).alias("date")).agg(F.avg(value).alias("value"))


def ordered(extra: list[str] = ()) -> Window:
    """The series' own order; entities apart, so that each is a group of its own."""
    return Window.partitionBy("entity").orderBy("date", *extra)


def rolling(s: DataFrame, width: int = 7) -> DataFrame:
    w = ordered().rowsBetween(1 - width, 0)
    return s.withColumn("rolling_mean", F.avg("value").over(w)).withColumn("rolling_std", F.stddev_samp("value").over(w))


def smooth(s: DataFrame, reach: int = 1) -> DataFrame:
    return s.withColumn("smooth", F.avg("value").over(ordered().rowsBetween(-reach, reach)))


def recent_against_earlier(s: DataFrame, n: int = 7) -> DataFrame:
    """Mean of the last n points against the mean of those before, by entity."""
    r = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("date")))
    return s.withColumn("r", r).groupBy("entity").agg(F.avg(F.when(F.col("r") <= n, F.col("value"))).alias("recent"), F.avg(F.when(F.col("r") > n, F.col("value"))).alias("earlier"))


def turns(s: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Local peaks and valleys that stand out from both neighbours by more than the threshold."""
    w = ordered()
    before, after = F.col("value") - F.lag("value").over(w), F.col("value") - F.lead("value").over(w)
    kind = F.when((before > threshold) & (after > threshold), "peak").when((before < -threshold) & (after < -threshold), "valley")
    return s.withColumn("turn", kind).where("turn IS NOT NULL")


def spikes(s: DataFrame, high: float = 2.0, near: float = 1.5) -> DataFrame:
    """Points over `high` means whose neighbours are not over `near` means."""
    mean = F.avg("value").over(Window.partitionBy("entity"))
    w = ordered()
    marked = s.withColumn("mean", mean).withColumn("before", F.coalesce(F.lag("value").over(w), F.lit(0.0))).withColumn("after", F.coalesce(F.lead("value").over(w), F.lit(0.0)))
    return marked.where((F.col("value") > high * F.col("mean")) & (F.col("before") <= near * F.col("mean")) & (F.col("after") <= near * F.col("mean"))).drop("before", "after")


def autocorrelation(s: DataFrame, lag: int) -> DataFrame:
    """(entity, r, n): correlation of values with those `lag` rows before."""
    return s.withColumn("past", F.lag("value", lag).over(ordered())).groupBy("entity").agg(F.corr("value", "past").alias("r"), F.count("past").alias("n"))


def seasonality(s: DataFrame, lag: int = 12, least: int = 24, over: float = 0.3) -> DataFrame:
    """(entity, n, r, seasonal): the correlation at a lag, and whether it is over the limit in a series long enough."""
    n = s.groupBy("entity").agg(F.count("*").alias("n"))
    r = autocorrelation(s, lag).select("entity", "r")
    return n.join(r, "entity").select("entity", "n", "r", F.coalesce((F.col("n") >= least) & (F.abs("r") > over), F.lit(False)).alias("seasonal"))


def chains(df: DataFrame, entity: str, time: str, gap: str = "INTERVAL 30 MINUTES") -> DataFrame:
    """Numbers each entity's events by chain: a gap longer than `gap` starts a new one."""
    w = Window.partitionBy(entity).orderBy(time)
    late = F.col(time) > F.lag(time).over(w) + F.expr(gap)
    return df.withColumn("_new", F.coalesce(late.cast("int"), F.lit(0))).withColumn("chain", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def recent_drift(s: DataFrame, width: int = 7) -> DataFrame:
    """(entity, drift, last, n): mean of the last `width` differences."""
    w = ordered()
    r = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("date")))
    marked = s.withColumn("step", F.col("value") - F.lag("value").over(w)).withColumn("r", r)
    return marked.groupBy("entity").agg(F.avg(F.when(F.col("r") <= width, F.col("step"))).alias("drift"), F.max_by("value", "date").alias("last"), F.max("date").alias("last_date"), F.count("*").alias("n"))


def drift_forecast(s: DataFrame, steps: int = 12, width: int = 7, least: int = 30) -> DataFrame:
    """Last value plus k times the recent drift, for series of `least` points or more; direction and strength."""
    base = recent_drift(s, width).where(F.col("n") >= least)
    size = F.abs(C.share(F.col("drift"), F.col("last")))
    labelled = base.withColumn("direction", F.when(F.col("drift") > 0, "up").when(F.col("drift") < 0, "down").otherwise("flat")).withColumn("strength", F.when(size > 0.05, "strong").when(size > 0.01, "moderate").otherwise("weak"))
    return labelled.select("entity", "direction", "strength", F.explode(F.sequence(F.lit(1), F.lit(min(12, steps)))).alias("k"), "last", "drift").withColumn("forecast", F.col("last") + F.col("k") * F.col("drift")).drop("last", "drift")


def last_points(s: DataFrame, n: int = 30) -> DataFrame:
    return s.withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("date")))).where(F.col("r") <= n).drop("r")


def stats(s: DataFrame) -> DataFrame:
    return s.groupBy("entity").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.max_by("value", "date").alias("last"))


def period_counts(df: DataFrame, time: str, unit: str) -> DataFrame:
    return df.where(F.col(time).isNotNull()).groupBy(F.date_trunc(unit, time).alias("period")).agg(F.count("*").alias("n"))


def seasonal(df: DataFrame, time: str, part: str = "weekday", over: float = 0.3) -> DataFrame:
    """(bucket, n, deviation): buckets of the week or year against their mean count; strong ones beyond `over`."""
    bucket = F.weekday(time) if part == "weekday" else F.month(time)
    counts = df.where(F.col(time).isNotNull()).groupBy(bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    mean = F.avg("n").over(Window.partitionBy())  # 12 rows at most
    return counts.withColumn("deviation", F.col("n") / mean - 1).withColumn("strong", F.abs("deviation") > over)


def trend_line(s: DataFrame) -> DataFrame:
    """Least squares over the point's number: slope, intercept, r2, n and a direction beyond 5 % of the mean."""
    x = s.withColumn("x", (F.row_number().over(ordered()) - 1).cast("double"))
    out = x.groupBy("entity").agg(F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"), F.regr_r2("value", "x").alias("r2"), F.avg("value").alias("mean"), F.count("*").alias("n"))
    return out.withColumn("direction", F.when(F.col("slope") > 0.05 * F.col("mean"), "up").when(F.col("slope") < -0.05 * F.col("mean"), "down").otherwise("flat"))


def count_anomalies(counts: DataFrame, over: float = 2.0, least: int = 7) -> DataFrame:
    """Periods whose count lies more than `over` population deviations from the mean."""
    total = counts.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.count("*").alias("k")).where((F.col("std") > 0) & (F.col("k") >= least))
    z = (F.col("n") - F.col("mean")) / F.col("std")
    return counts.join(F.broadcast(total)).withColumn("z", z).where(F.abs("z") > over).select("period", "n", "z")


def anomalous_dates(df: DataFrame, time: str, cols: list[str], top: int = 3) -> DataFrame:
    """Dates with most outliers over the columns."""
    from tallyloom.operators.quality import beyond, bounds

    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    flat = df.select(F.to_date(time).alias("date"), F.explode(cells).alias("x")).select("date", "x.column", "x.value").join(F.broadcast(bounds(df, cols)), "column")
    return flat.where(beyond()).groupBy("date").agg(F.count("*").alias("n_outliers")).orderBy(F.desc("n_outliers"), "date").limit(top)


def grouping(df: DataFrame, time: str, candidates: list[str]) -> DataFrame:
    """How well each column splits the table into series, best first: no more than a row a date and entity, density of
    dates, length and evenness. Columns that cannot are scored 0."""
    days = df.agg(F.count_distinct(F.to_date(time)).alias("days")).first()["days"]
    out = None
    for c in candidates:
        cell = df.where(F.col(c).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(c).cast("string").alias("e"), F.to_date(time).alias("d")).agg(F.count("*").alias("k"))
        by = cell.groupBy("e").agg(F.sum("k").alias("n"), F.count("*").alias("days"), F.max("k").alias("most"))
        cv = F.coalesce(C.share(F.stddev_pop("n"), F.avg("n")), F.lit(0.0))
        density = F.avg(F.col("days") / max(1, days))
        score = 0.5 * density + 0.25 * F.least(F.avg("days") / 90, F.lit(1.0)) + 0.25 / (1 + cv)
        one = by.agg(F.lit(c).alias("column"), F.count("*").alias("entities"), F.min("n").alias("least"), F.max("most").alias("most"), density.alias("density"), score.alias("score"))
        out = one if out is None else out.unionByName(one)
    bad = (F.col("most") > 1) | (F.col("least") < 3) | (F.col("density") < 0.05)
    return out.withColumn("score", F.when(F.col("entities") == 1, 1.0).when(bad, 0.0).otherwise(F.col("score")))


def ljung_box(s: DataFrame, lags: int | None = None) -> DataFrame:
    """(entity, n, h, q): Ljung-Box Q over min(20, n/5) lags, autocorrelations about the mean of the whole series.

    The lagged products come from one array per entity: a series is a row here.
    """
    packed = s.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("date", "value"))).alias("p"), F.avg("value").alias("m"), F.count("*").alias("n"))
    x = F.transform("p", lambda e: e["value"] - F.col("m"))
    h = F.least(F.lit(lags or 20), F.greatest(F.floor(F.col("n") / 5), F.lit(1))).cast("int")
    full = packed.withColumn("x", x).withColumn("h", h).withColumn("c0", F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).where("c0 > 0 AND n > 2")
    lagged = full.select("entity", "n", "h", "c0", "x", F.explode(F.sequence(F.lit(1), F.col("h"))).alias("k"))
    prods = F.aggregate(F.zip_with(F.slice("x", F.lit(1), F.col("n").cast("int") - F.col("k")), F.slice("x", F.col("k") + 1, F.col("n").cast("int")), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    rho = prods / F.col("c0")
    return lagged.groupBy("entity", "n", "h").agg((F.first(F.col("n") * (F.col("n") + 2)) * F.sum(rho * rho / (F.col("n") - F.col("k")))).alias("q"))


#: MacKinnon's surfaces for the Dickey-Fuller t with constant and trend.
TAU_MIN, TAU_STAR = -16.18, -2.89
SMALL_P = (3.2512, 1.6047, 0.049588)
LARGE_P = (2.5261, 0.61654, -0.37956, -0.060285)


def adf(values: np.ndarray, most_lags: int | None = None) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller t with constant and trend, its p-value, and the lags that the AIC chose."""
    y = np.asarray(values, float)
    n = len(y)
    dy = np.diff(y)
    most = most_lags if most_lags is not None else max(0, min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 4))

    def regress(p: int, start: int):
        rows = np.arange(start, len(dy))
        x = np.column_stack([y[rows], np.ones(len(rows)), np.arange(1, len(rows) + 1), *[dy[rows - i] for i in range(1, p + 1)]])
        beta, *_ = np.linalg.lstsq(x, dy[rows], rcond=None)
        res = dy[rows] - x @ beta
        return x, beta, float(res @ res), len(rows)

    best = min(range(most + 1), key=lambda p: (lambda x, b, ss, m: m * math.log(max(ss, 1e-300) / m) + 2 * x.shape[1])(*regress(p, most)))
    x, beta, ss, m = regress(best, best)
    cov = np.linalg.pinv(x.T @ x) * ss / max(1, m - x.shape[1])
    t = float(beta[0] / math.sqrt(max(cov[0, 0], 1e-300)))
    if t <= TAU_MIN:
        return t, 0.0, best
    if t > 0.7:
        return t, 1.0, best
    z = sum(c * t**i for i, c in enumerate(SMALL_P if t <= TAU_STAR else LARGE_P))
    return t, 1 - mathx.normal_sf(z), best


def diagnose(s: DataFrame, least: int = 10) -> DataFrame:
    """Stationarity, autocorrelation, seasonality and a verdict for every series; a series is a group of its own."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date")["value"].to_numpy(float)
        n = len(x)
        if n < least or np.ptp(x) == 0:
            return pd.DataFrame([[pdf["entity"].iloc[0], n, None, None, None, None, None, "too short"]], columns=names)
        t, p, _ = adf(x)
        h = max(1, min(20, n // 5))
        c = x - x.mean()
        rho = np.array([c[k:] @ c[: n - k] for k in range(1, h + 1)]) / (c @ c)
        q = n * (n + 2) * (rho**2 / (n - np.arange(1, h + 1))).sum()
        pq = mathx.chi2_sf(q, h)
        r12 = float(np.corrcoef(x[12:], x[:-12])[0, 1]) if n >= 24 and np.ptp(x[12:]) and np.ptp(x[:-12]) else None
        verdict = {(True, True): "model directly", (True, False): "white noise", (False, True): "difference first", (False, False): "no structure"}[p < 0.05, pq < 0.05]
        return pd.DataFrame([[pdf["entity"].iloc[0], n, t, p, q, pq, r12, verdict]], columns=names)

    names = ["entity", "n", "adf", "adf_p", "ljung_box", "ljung_box_p", "r12", "verdict"]
    return s.groupBy("entity").applyInPandas(one, "entity string, n long, adf double, adf_p double, ljung_box double, ljung_box_p double, r12 double, verdict string")


def arima(values: np.ndarray, p: int = 1, d: int = 0, q: int = 0, steps: int = 12) -> np.ndarray:
    """Forecasts of an ARIMA(p, d, q) fitted by Hannan and Rissanen's two regressions."""
    y = np.asarray(values, float)
    tails = []
    for _ in range(d):
        tails.append(y[-1])
        y = np.diff(y)
    mean = y.mean()
    z = y - mean
    long = min(len(z) // 4, max(p, q) + 8) if q else p
    res = np.zeros(len(z))
    if q:
        x = np.column_stack([z[long - i : len(z) - i] for i in range(1, long + 1)])
        b, *_ = np.linalg.lstsq(x, z[long:], rcond=None)
        res[long:] = z[long:] - x @ b
    at = max(p, long + q if q else 0)
    cols = [z[at - i : len(z) - i] for i in range(1, p + 1)] + [res[at - i : len(z) - i] for i in range(1, q + 1)]
    b = np.linalg.lstsq(np.column_stack(cols), z[at:], rcond=None)[0] if cols else np.zeros(0)
    zz, rr = list(z), list(res)
    for _ in range(steps):
        zz.append(sum(b[i] * zz[-1 - i] for i in range(p)) + sum(b[p + i] * rr[-1 - i] for i in range(q)))
        rr.append(0.0)
    out = np.array(zz[len(z) :]) + mean
    for last in reversed(tails):
        out = last + np.cumsum(out)
    return out


def arima_forecast(s: DataFrame, p: int = 1, d: int = 1, q: int = 1, steps: int = 12) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date")["value"].to_numpy(float)
        f = arima(x, p, d, q, steps) if len(x) >= 10 + p + d + q else []
        return pd.DataFrame({"entity": pdf["entity"].iloc[0], "k": range(1, len(f) + 1), "forecast": f})

    return s.groupBy("entity").applyInPandas(one, "entity string, k long, forecast double")


def verdict(stationary: Column, correlated: Column) -> Column:
    return F.when(stationary & correlated, "model directly").when(stationary, "white noise").when(correlated, "difference first").otherwise("no structure")
