"""What charts show, as small tables: bars and slices, histograms and boxes, and the four panels of a series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import columns as C
from tallyloom.functions.tables import exact_quartiles
from tallyloom.operators import profile as P
from tallyloom.operators import timeseries as T


def boxes(df: DataFrame, cols: list[str], reach: float = 1.5) -> DataFrame:
    """(column, low, q1, median, q3, high, n_outliers): quartiles, and the values farthest out within so many interquartile
    ranges of them. Columns without values are left out."""
    held = C.long_form(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    q = exact_quartiles(held).select("column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("value") >= F.col("q1") - reach * iqr) & (F.col("value") <= F.col("q3") + reach * iqr)
    cells = held.join(F.broadcast(q), "column")  # a row a column
    return cells.groupBy("column", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("value"))).alias("low"), F.max(F.when(inside, F.col("value"))).alias("high"), F.count_if(~inside).alias("n_outliers"))


def chart_data(df: DataFrame, types: dict[str, str], value: str | None = None, bins: int = 30, top: int = 5) -> dict[str, Callable[[], DataFrame]]:
    """Charts by name, each planned when asked for: bars of every category, histogram and box of every number, and a
    series' line, rolling mean, weekdays and months."""
    of = lambda *kinds: [c for c, t in types.items() if t in kinds]
    out: dict[str, Callable[[], DataFrame]] = {f"bars of {c}": lambda c=c: P.breakdown(df, c, top) for c in of("categorical", "categorical_numeric", "ordinal")}
    numbers, times = of("continuous"), of("datetime")
    out |= {f"histogram of {c}": lambda c=c: P.histogram(df, c, bins) for c in numbers}
    if numbers:
        out["boxes"] = lambda: boxes(df, numbers)
    if times and (value or numbers):
        s = lambda: T.series(df, times[0], value or numbers[0])
        out |= {"line": s, "rolling": lambda: T.rolling(s()), "weekdays": lambda: T.seasonal(df, times[0], "weekday"), "months": lambda: T.seasonal(df, times[0], "month")}
    return out
