"""Facts about a table, the scenarios that they call for, the records behind them, and ranked insights."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import association as A
from tallyloom.operators import multitable as M
from tallyloom.operators import profile as P
from tallyloom.operators import quality as Q
from tallyloom.operators import rules as U
from tallyloom.operators.advice import roles_in_models

#: id -> (group, name, the fact that calls for it, least value of that fact, priority)
SCENARIOS: dict[str, tuple[str, str, str, float, str]] = {
    "A1": ("overview", "table overview", "rows", 1, "high"), "A2": ("overview", "column types", "columns", 1, "medium"), "A3": ("overview", "quality score", "rows", 1, "high"), "A4": ("overview", "relations", "relations", 1, "medium"),
    "B1": ("relation", "numeric correlation", "correlated_pairs", 1, "high"), "B2": ("relation", "category association", "associated_pairs", 1, "medium"), "B3": ("relation", "group differences", "group_pairs", 1, "medium"), "B4": ("relation", "table joins", "relations", 1, "low"), "B5": ("relation", "redundant fields", "redundant_pairs", 1, "low"),
    "C1": ("time", "trend", "time_columns", 1, "high"), "C2": ("time", "seasonality", "time_columns", 1, "medium"), "C3": ("time", "forecast", "series_points", 30, "medium"), "C4": ("time", "anomalous dates", "time_columns", 1, "medium"),
    "D1": ("model", "segmentation", "numeric_count", 3, "medium"), "D2": ("model", "prediction", "predictable", 1, "medium"), "D3": ("model", "concentration", "categorical_count", 1, "low"),
    "E1": ("quality", "rule violations", "rules", 1, "high"), "E2": ("quality", "outliers", "outlier_columns", 1, "high"), "E3": ("quality", "missing values", "missing_columns", 1, "high"), "E4": ("quality", "duplicates", "duplicate_rows", 1, "medium"),
    "F1": ("text", "text columns", "text_columns", 1, "low"), "F2": ("text", "identifiers", "identifier_count", 1, "low"), "F3": ("text", "entities by relation", "relations", 1, "low"), "F4": ("shape", "skewed columns", "skewed_columns", 1, "low"), "F5": ("shape", "dates of outliers", "time_columns", 1, "low"),
}
PRIORITY = {"high": 0, "medium": 1, "low": 2}


def types_of(df: DataFrame, mode: str = "strict") -> dict[str, str]:
    return {r["column"]: r["semantic_type"] for r in P.profile(df, mode=mode).collect()}


def facts(df: DataFrame, types: dict[str, str], relations: int = 0, rules: int = 0) -> DataFrame:
    """(fact, value): counts of what there is. Each part is an aggregate; only the counts are gathered."""
    of = lambda *kinds: [c for c, t in types.items() if t in kinds]
    cont, cats, times = of("continuous"), of("categorical", "categorical_numeric"), of("datetime")
    rows = df.agg(F.count("*").alias("rows")).select(F.lit("rows").alias("fact"), F.col("rows").cast("double").alias("value"))
    known = {
        "columns": len(types), "numeric_count": len(cont), "categorical_count": len(cats), "identifier_count": len(of("identifier")), "text_columns": len(of("text")), "time_columns": len(times),
        "relations": relations, "rules": rules, "predictable": int(len(cont) >= 2),
    }
    out = rows.unionByName(df.sparkSession.createDataFrame([(k, float(v)) for k, v in known.items()], "fact string, value double"))
    put = lambda d, name: d.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("fact"), "value")
    out = out.unionByName(put(Q.missing(df), "missing_columns"))
    out = out.unionByName(Q.duplicates(df).select(F.lit("duplicate_rows").alias("fact"), F.col("n_extra").cast("double").alias("value")))
    if cont:
        out = out.unionByName(put(Q.outliers(df, cont).where("n_outliers > 0"), "outlier_columns")).unionByName(put(P.summary(df, cont).where(F.abs("skew") > 1), "skewed_columns"))
    if len(cont) > 1:
        out = out.unionByName(put(A.correlations(df, cont).where(F.abs("r") > 0.3), "correlated_pairs")).unionByName(put(A.redundant(df, cont), "redundant_pairs"))
    if times:
        out = out.unionByName(df.agg(F.count_distinct(F.to_date(times[0])).cast("double").alias("value")).select(F.lit("series_points").alias("fact"), "value"))
    return out


def scenarios(found: DataFrame) -> DataFrame:
    """(scenario, group, name, priority, fact, value) of every scenario whose fact is large enough, urgent ones first."""
    rows = [(k, area, name, fact, float(least), urgent) for k, (area, name, fact, least, urgent) in SCENARIOS.items()]
    table = found.sparkSession.createDataFrame(rows, "scenario string, area string, name string, fact string, least double, priority string")
    order = F.create_map(*[F.lit(x) for k, v in PRIORITY.items() for x in (k, v)])[F.col("priority")]
    return F.broadcast(table).join(found, "fact").where(F.col("value") >= F.col("least")).orderBy(order, "scenario").select("scenario", "area", "name", "priority", "fact", "value")


def execute(df: DataFrame, scenario: str, key: list[str], types: dict[str, str], **more: Any) -> DataFrame:
    """The table behind a scenario: records with row keys, or a summary."""
    of = lambda *kinds: [c for c, t in types.items() if t in kinds]
    cont, cats, times = of("continuous"), of("categorical", "categorical_numeric"), of("datetime")
    from tallyloom.operators import timeseries as T
    from tallyloom.operators.models import segments

    series = lambda: T.series(df, times[0], more.get("value") or cont[0])
    table = {
        "A1": lambda: P.profile(df), "A2": lambda: P.profile(df), "A3": lambda: Q.score(df, cont, times[0] if times else None, more.get("as_of", "1970-01-01")), "B1": lambda: A.high_correlations(df, cont, 0.3),
        "B2": lambda: A.categorical_pairs(df, cats), "B3": lambda: A.eta_squared(df, cats[0], cont[0]), "B5": lambda: A.redundant(df, cont), "C1": lambda: T.trend_line(series()), "C2": lambda: T.seasonal(df, times[0]), "C3": lambda: T.drift_forecast(series()),
        "C4": lambda: T.anomalous_dates(df, times[0], cont), "D1": lambda: segments(df, cont)[1], "D3": lambda: Q.concentration(df, cats), "E1": lambda: U.violations(df, key, more["rules"]), "E2": lambda: Q.outlier_rows(df, cont, key),
        "E3": lambda: Q.missing_patterns(df, key[0], df.columns), "E4": lambda: Q.duplicate_rows(df, key), "F4": lambda: P.summary(df, cont).where(F.abs("skew") > 1), "F5": lambda: T.anomalous_dates(df, times[0], cont),
        "A4": lambda: M.discover(more["tables"], more.get("strip_prefix", False)), "B4": lambda: M.discover(more["tables"], more.get("strip_prefix", False)).select("from_table", "to_table", "relation_type", "common"),
        "D2": lambda: roles_in_models(df, types), "F1": lambda: P.profile(df.select(*of("text"))) if of("text") else P.profile(df).limit(0), "F2": lambda: P.identifiers(df, of("identifier")),
        "F3": lambda: M.common_keys(df, more["tables"][more["other"]], more["key"], more["other_key"]),
    }
    if scenario not in SCENARIOS:
        raise ValueError(f"no scenario {scenario}")
    return table[scenario]()


def ranking(records: DataFrame, by: str) -> DataFrame:
    """(by, n, share): records by rule, field or entity."""
    total = records.agg(F.count("*").alias("total"))
    return records.groupBy(by).agg(F.count("*").alias("n")).join(F.broadcast(total)).select(by, "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), by)


def by_year(records: DataFrame, time: str) -> DataFrame:
    return records.groupBy(F.year(time).cast("long").alias("year")).agg(F.count("*").alias("n"))


def cross(records: DataFrame, a: str, b: str, per: int = 5, most: int = 30) -> DataFrame:
    """(a, b, n): the commonest b of each a, and of those the commonest."""
    counts = records.groupBy(a, b).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(a).orderBy(F.desc("n"), b))
    return counts.withColumn("r", rank).where(F.col("r") <= per).drop("r").orderBy(F.desc("n"), a, b).limit(most)


def conclusions(found: dict[str, float]) -> list[tuple[str, str]]:
    """(level, text) from facts by name: what to look at first."""
    g = lambda k: found.get(k, 0)
    rules = [
        (g("missing_columns") > 0, "warning", f"{g('missing_columns'):.0f} columns have missing values"), (g("outlier_columns") > 0, "warning", f"{g('outlier_columns'):.0f} columns have outliers"), (g("duplicate_rows") > 0, "warning", f"{g('duplicate_rows'):.0f} rows are copies"),
        (g("correlated_pairs") > 0, "info", f"{g('correlated_pairs'):.0f} pairs of numbers move together"), (g("skewed_columns") > 0, "info", f"{g('skewed_columns'):.0f} columns are skewed"), (g("series_points") >= 30, "info", "the series is long enough to forecast"), (g("rows") > 100_000, "info", "the table is large"),
    ]
    return [(level, text) for hit, level, text in rules if hit]


def angles(types: dict[str, str], missing: int = 0, most: int = 6) -> list[str]:
    """Ways to look at the table, from its types."""
    n = lambda *kinds: sum(t in kinds for t in types.values())
    rules = [("trend", n("datetime") and n("continuous")), ("contrast", n("categorical") and n("continuous")), ("correlation", n("continuous") >= 2), ("forecast", n("datetime") and n("continuous")), ("anomaly", n("continuous") or missing), ("association", n("categorical") >= 2)]
    return [name for name, ok in rules if ok][:most]


def questions(types: dict[str, str]) -> list[str]:
    """Questions that the table can answer, by filling templates with its columns."""
    of = lambda *kinds: [c for c, t in types.items() if t in kinds]
    num, cat, time = of("continuous"), of("categorical", "categorical_numeric"), of("datetime")
    out = [f"How is {c} distributed?" for c in num[:3]] + [f"Which values of {c} are most frequent?" for c in cat[:3]]
    out += [f"How does {num[0]} differ by {c}?" for c in cat[:3] if num] + [f"How does {c} change over {time[0]}?" for c in num[:3] if time]
    return out + [f"Do {a} and {b} move together?" for a, b in zip(num, num[1:3], strict=False)]


def caption(kind: str, column: str, r: dict[str, Any]) -> str:
    """One sentence for a chart's data."""
    if kind == "histogram":
        side = "to the right" if r.get("skew", 0) > 1 else "to the left" if r.get("skew", 0) < -1 else "evenly"
        return f"{column} lies between {r['min']:g} and {r['max']:g} around {r['median']:g}, spread {side}."
    if kind == "bar":
        return f"{r['mode']} is the commonest {column}, in {r['mode_pct']:g} % of the rows."
    return f"{column} goes {r['direction']} by {r['slope']:g} a step (r2 {r['r2']:.2f})."


#: Words of a request and what it asks for, the first that fits; fixed values.
INTENTS = {"predict": ("predict", "forecast", "estimate"), "query": ("show", "list", "which", "how many"), "explain": ("why", "explain")}


def intents(requests: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """requests with `intent` and `values`, a map from a column's name to the value that the text gives it, by patterns."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    kind = F.coalesce(*[F.when(low.rlike("|".join(words)), k) for k, words in INTENTS.items()], F.lit("other"))
    named = [F.struct(F.lit(c).alias("key"), F.regexp_extract(low, rf"{re.escape(c.lower())}\s*(?:=|is|of|:)\s*([-\w.]+)", 1).alias("value")) for c in columns]
    values = F.map_from_entries(F.filter(F.array(*named), lambda x: x["value"] != "")) if named else F.create_map().cast("map<string,string>")
    return requests.withColumns({"intent": kind, "values": values})


def intent(spark, text: str, columns: list[str]) -> dict[str, Any]:
    """One request."""
    r = intents(spark.createDataFrame([(text,)], "text string"), "text", columns).first()
    return {"intent": r["intent"], "values": r["values"]}


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables' profiles side by side."""
    x, y = (P.profile(d).select("column", F.col("n").alias(f"n_{s}"), F.col("missing_pct").alias(f"missing_pct_{s}"), F.col("n_unique").alias(f"n_unique_{s}")) for d, s in ((a, "a"), (b, "b")))
    return x.join(y, "column", "full")
