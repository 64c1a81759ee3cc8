"""Columns derived from time columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def features(df: DataFrame, col: str, level: str = "basic") -> DataFrame:
    """Year, month, quarter; with level full also ISO week, weekday from Monday = 0, day and weekend. Each remembers in
    its metadata what it was made of."""
    if level == "none":
        return df
    made = {"year": F.year(col), "month": F.month(col), "quarter": F.quarter(col)}
    if level == "full":
        made |= {"week": F.weekofyear(col), "weekday": F.weekday(col), "day": F.dayofmonth(col), "is_weekend": F.weekday(col) >= 5}
    out = df.withColumns({f"{col}_{k}": v for k, v in made.items()})
    for k in made:
        out = out.withMetadata(f"{col}_{k}", {"derived_from": col})
    return out


def derived_from(df: DataFrame, col: str) -> str | None:
    return df.schema[col].metadata.get("derived_from")


def same_source(df: DataFrame, a: str, b: str) -> bool:
    """True where both columns come from one time column, or one from the other: no pair to look for relations in."""
    x, y = derived_from(df, a) or a, derived_from(df, b) or b
    return x == y
