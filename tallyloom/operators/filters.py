"""Row filters, ordering, paging and set operations behind the preview and query calls."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import quality as Q


def predicate(df: DataFrame, field: str, op: str, value: Any = None) -> Column | None:
    """The condition of one filter; None where the field is unknown or the value has the wrong shape. Nulls fail."""
    if field not in df.columns:
        return None
    c = F.col(field)
    plain = {"eq": lambda: c == value, "gt": lambda: c > value, "lt": lambda: c < value, "gte": lambda: c >= value, "lte": lambda: c <= value, "is_null": c.isNull, "is_not_null": c.isNotNull, "in": lambda: c.isin(list(value))}
    if op in plain:
        return plain[op]()
    if op == "between":
        return c.between(*value) if isinstance(value, (list, tuple)) and len(value) == 2 else None
    if op in ("contains", "icontains"):
        return c.cast("string").rlike(str(value) if op == "contains" else f"(?i){value}")
    raise ValueError(f"unknown filter: {op}")


def apply(df: DataFrame, filters: list[dict[str, Any]]) -> DataFrame:
    """All filters, joined by AND. is_outlier looks at the rows of df as given."""
    out = df
    conditions = []
    for f in filters:
        if f["op"] == "is_outlier":
            out = outlier_filter(out, f["field"])
        elif f["op"] == "expr":
            out = expression(out, f["value"])
        elif (p := predicate(df, f["field"], f["op"], f.get("value"))) is not None:
            conditions.append(p)
    return out.where(reduce(lambda a, b: a & b, conditions)) if conditions else out


def expression(df: DataFrame, text: str) -> DataFrame:
    """Rows for which a boolean expression holds; a text that is no such expression changes nothing."""
    try:
        return df.where(text)
    except (AnalysisException, ParseException):
        return df


def outlier_filter(df: DataFrame, field: str) -> DataFrame:
    """Rows beyond the field's outlier bounds; no row where it has no spread."""
    limits = Q.bounds(df, [field]).select("low", "high")
    return df.join(F.broadcast(limits)).where((F.col(field) < F.col("low")) | (F.col(field) > F.col("high"))).drop("low", "high")


def violates(left: list[str], right: list[str], tolerance: float = 0.01) -> Column:
    """All fields are there, and the sums of both sides differ by more than tolerance."""
    add = lambda cols: reduce(lambda a, b: a + b, [F.col(c).cast("double") for c in cols])
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in left + right])
    return there & (F.abs(add(left) - add(right)) > tolerance)


#: What a plan that only reads is made of, as the parser names it.
READS = frozenset("""Project Filter Aggregate Join UnresolvedRelation UnresolvedSubqueryColumnAliases SubqueryAlias Sort GlobalLimit LocalLimit
Offset Distinct Deduplicate Union Intersect Except UnresolvedWith Window WithWindowDefinition UnresolvedHaving OneRowRelation UnresolvedInlineTable
ResolvedInlineTable LocalRelation LateralJoin Generate Pivot Unpivot Sample UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedHint""".split())


def is_query(spark, text: str) -> bool:
    """True if the text parses to a plan all of whose parts only read; what is not known to is refused."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception:
        return False
    left = [plan]
    while left:
        node = left.pop()
        if node.getClass().getSimpleName().removesuffix("$") not in READS:
            return False
        for below in (node.children(), node.innerChildren()):
            left += [below.apply(i) for i in range(below.size())]
    return True


def lineage(df: DataFrame, key: str, ids: list | None = None, low: Any = None, high: Any = None, equal: dict[str, Any] | None = None) -> DataFrame:
    """Rows by list of ids, range of ids, and equality or membership of other columns."""
    out = df.where(F.col(key).isin(ids)) if ids is not None else df
    if low is not None or high is not None:
        out = out.where((F.col(key) >= F.lit(low) if low is not None else F.lit(True)) & (F.col(key) <= F.lit(high) if high is not None else F.lit(True)))
    for c, v in (equal or {}).items():
        out = out.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return out


def preview(df: DataFrame, order: list[str], filters: list[dict] = (), fields: list[str] | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """A page of the filtered rows; unknown fields are left out."""
    out = apply(df, list(filters)).orderBy(*order).offset((page - 1) * size).limit(size)
    return out.select(*[c for c in fields if c in df.columns]) if fields else out


def query_data(df: DataFrame, filters: list[dict] = (), limit: int = 100, fields: list[str] | None = None, order_by: str | None = None, descending: bool = False, tie: list[str] = ()) -> DataFrame:
    """The chat tool's query: filters, one order (nulls last either way), limit, fields."""
    out = apply(df, list(filters))
    if order_by in df.columns:
        c = F.col(order_by)
        out = out.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *tie)
    out = out.limit(limit)
    return out.select(*[c for c in fields if c in df.columns]) if fields else out


def most_common(df: DataFrame, col: str, k: int) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(k)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def stable_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows that depend on the key and the seed alone, not on the layout of the data."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
