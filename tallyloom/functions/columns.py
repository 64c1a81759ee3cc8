"""Column expressions and column lists that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
REAL = (T.FloatType, T.DoubleType, T.DecimalType)
TIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
#: Numbers that stand for a missing one.
SENTINELS = (-999, -9999, 999999, 9999999)
#: All characters that are spaces, as SQL's trim takes them off.
BLANKS = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def trimmed(c: Column | str) -> Column:
    return F.trim(c, F.lit(BLANKS))


def whole(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, WHOLE)]


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, WHOLE + REAL)]


def strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def times(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, TIME)]


def share(part: Column, whole_: Column, scale: float = 1.0) -> Column:
    """part / whole * scale; null where whole is 0."""
    return F.try_divide(part.cast("double") * F.lit(scale), whole_.cast("double"))


def long_form(df: DataFrame, cols: list[str], kind: str = "double") -> DataFrame:
    """(column, value): a row for each row and column; one pass over the table, only cols are read."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in cols])
    return df.select(F.explode(cells).alias("cell")).select("cell.column", "cell.value")


def tidy(df: DataFrame) -> DataFrame:
    """NaN becomes null in every real column, so that missing values are of one kind."""
    real = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in real})


def quartiles(value: str = "value", exact: bool = True, accuracy: int = 10_000) -> Column:
    """Lower quartile, median and upper quartile. exact keeps a count for every distinct value; without it the state is
    bounded and the result is a value of the column near the rank."""
    at = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    return F.percentile(value, at) if exact else F.percentile_approx(value, at, accuracy)


def sample_skew(value: str = "value") -> Column:
    n = F.count(value).cast("double")
    return F.skewness(value) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))


def sample_kurtosis(value: str = "value") -> Column:
    n = F.count(value).cast("double")
    return (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(value) + 6)
