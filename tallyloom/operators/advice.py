"""What a column, a series, a corpus or a set of rules is fit for, and what to do next: checks and ranked findings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import timeseries as S

CATEGORIES = ("categorical", "categorical_numeric", "ordinal")
# Signs that part a field's name from its display name, tried in this order, and headings of such tables.
SIGNS = ("：", ":", "=", "→")
DESIGN_HEADINGS, NAME_HEADING, TABLE_HEADINGS = ("设计名", "字段名"), "中文名", ("成员设计名", "字段名")


def series_advice(s: DataFrame, least: int = 30) -> DataFrame:
    """(entity, n, suitable, method, has_trend, has_seasonality) of series (entity, date, value): at least so many points,
    the verdict on stationarity and autocorrelation, a slope over a hundredth of the deviation, and a correlation over 0.3
    at lag 12 where there are more than 24 points."""
    line = S.trend_line(s).select("entity", "slope")
    spread = s.groupBy("entity").agg(F.stddev_samp("value").alias("std"))
    told = S.diagnose(s, 1).join(line, "entity", "left").join(spread, "entity")
    method = F.when(F.col("n") < least, "mean or median").when(F.col("verdict") == "model directly", "ARIMA or SARIMA").when(F.col("verdict") == "difference first", "ARIMA after differencing").when(F.col("verdict") == "no structure", "trend line").otherwise("mean or median")
    return told.select(
        "entity", "n", ((F.col("n") >= least) & F.col("verdict").isin("model directly", "difference first")).alias("suitable"), method.alias("method"),
        F.coalesce((F.col("std") > 0) & (F.abs("slope") > 0.01 * F.col("std")), F.lit(False)).alias("has_trend"), F.coalesce((F.col("n") > 24) & (F.abs("r12") > 0.3), F.lit(False)).alias("has_seasonality"),
    )


def roles_in_models(df: DataFrame, types: dict[str, str], derived: set[str] = frozenset()) -> DataFrame:
    """(column, feature, regression_target, classification_target): nulls in at most half of the rows, numbers that vary,
    categories of two values or more; identifiers are no features, derived columns no targets. One pass for all columns."""
    cols = [c for c in df.columns if c in types]
    number = {f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.dataType.typeName().startswith("decimal")}
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(types[c]).alias("kind"), F.lit(c in derived).alias("derived"), F.coalesce(F.try_divide(F.count_if(F.col(c).isNull()), F.count("*")), F.lit(0.0)).alias("missing"),
            (F.stddev_samp(F.col(c)) if c in number else F.lit(None).cast("double")).alias("std"), (F.min(c) != F.max(c)).alias("two") if df.schema[c].dataType.typeName() not in ("array", "map", "struct") else F.lit(True).alias("two"),
        )
        for c in cols
    ])
    flat = df.agg(cells.alias("x")).select(F.explode("x").alias("x")).select("x.*")
    there = F.col("missing") <= 0.5
    varies = ~((F.col("kind") == "continuous") & (F.col("std") == 0))
    levels = ~F.col("kind").isin(*CATEGORIES) | F.coalesce(F.col("two"), F.lit(False))
    target = there & ~F.col("derived")
    return flat.select(
        "column", (there & varies & levels & (F.col("kind") != "identifier")).alias("feature"), (target & (F.col("kind") == "continuous") & F.coalesce(F.col("std") > 0, F.lit(False))).alias("regression_target"),
        (target & F.col("kind").isin(*CATEGORIES) & F.coalesce(F.col("two"), F.lit(False))).alias("classification_target"),
    )


def rule_advice(sums: DataFrame, keys: DataFrame | None = None, dependencies: DataFrame | None = None) -> DataFrame:
    """(priority, task, subject, share): rules that some rows break are to be mended and those that all keep to be watched;
    keys that miss some values are urgent; a dependency is a hint to normalise. sums is as rules.verify gives it, keys as
    multitable.discover, dependencies as rules.dependencies."""
    broken = F.col("satisfied_rows") < F.col("valid_rows")
    out = sums.where("valid_rows > 0").select(F.lit("medium").alias("priority"), F.when(broken, "mend violations").otherwise("watch the rule").alias("task"), F.col("rule").alias("subject"), F.col("confidence").alias("share"))
    if keys is not None:
        out = out.unionByName(keys.where("confidence < 1").select(F.lit("high").alias("priority"), F.lit("mend the key").alias("task"), F.concat_ws(" -> ", F.concat_ws(".", "from_table", "from_col"), F.concat_ws(".", "to_table", "to_col")).alias("subject"), F.col("confidence").alias("share")))
    if dependencies is not None:
        out = out.unionByName(dependencies.select(F.lit("low").alias("priority"), F.lit("normalise").alias("task"), F.concat_ws(" -> ", "a", "b").alias("subject"), F.lit(1.0).alias("share")))
    return out


def text_advice(docs: DataFrame, date: str | None = None) -> DataFrame:
    """(check, suitable, method, n): whether a corpus (text, and a date column if named) is large and long enough for
    statistics, series, clusters and topics. One pass."""
    full = F.when(F.length("text") > 0, F.length("text"))
    dated = F.col(date) if date else F.lit(None).cast("timestamp")
    r = docs.agg(F.count("*").alias("n"), F.avg(full).alias("mean"), F.count(dated).alias("dated"), F.count_distinct(dated).alias("days"))
    n, mean = F.col("n"), F.coalesce("mean", F.lit(0.0))
    rows = [
        ("sample_size", n >= 10, F.when(n < 10, "basic statistics").when(n < 50, "basic statistics and keywords").otherwise("all")),
        ("text_length", mean >= 10, F.when(F.col("mean").isNull(), None).when(mean < 10, "statistics").when(mean < 50, "keywords and sentiment").otherwise("all")),
        ("time_series", (F.col("dated") >= 10) & (F.col("days") >= 5), F.when((F.col("dated") >= 10) & (F.col("days") >= 5), "trends and anomalies")),
        ("clustering", (n >= 20) & (mean >= 20), F.when((n >= 20) & (mean >= 20), "k-means")),
        ("topic_modeling", (n >= 50) & (mean >= 50), F.when((n >= 50) & (mean >= 50), "LDA")),
    ]
    return r.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), ok.alias("suitable"), how.alias("method"), n.alias("n")) for k, ok, how in rows])).alias("x")).select("x.*")


def keywords_by_period(docs: DataFrame, date: str, period: str = "month", k: int = 10) -> DataFrame:
    """(period, rank, token, n): the commonest tokens of each day, month or year; docs has text and the date column."""
    form = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[period]
    tokens = docs.where(F.col(date).isNotNull()).select(F.date_format(date, form).alias("period"), F.explode(X.without_stop_words(X.tokens(F.col("text")))).alias("token"))
    counted = tokens.groupBy("period", "token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("n"), "token"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k).select("period", "rank", "token", "n")


def insights(entities: DataFrame, pairs: DataFrame, labels: DataFrame, clusters: DataFrame, hot: DataFrame, shifts: DataFrame, most: int = 20) -> DataFrame:
    """(kind, subject, score, priority): what stands out in a corpus, highest score first. entities is (entity, n), pairs
    (a, b, n, pmi), labels (label, n) of sentiment, clusters (label, size, share, words), hot (entity, recent, earlier) and
    shifts (entity, date, ...). All are small tables of counts; at most a few rows of each are taken."""
    top = lambda df, n, *order: df.orderBy(*order).limit(n)
    high = lambda test: F.when(test, "high").otherwise("medium")
    made = lambda df, kind, subject, score, priority: df.select(F.lit(kind).alias("kind"), subject.alias("subject"), F.least(score.cast("double"), F.lit(1.0)).alias("score"), priority.alias("priority"))
    first = F.row_number().over(Window.orderBy(F.desc("n"), "entity")) == 1  # of five rows
    out = made(top(entities, 5, F.desc("n"), "entity").withColumn("first", first), "hot_entity", F.col("entity"), F.col("n") / 100, high(F.col("first")))
    near = top(pairs, 5, F.desc("pmi"), "a", "b")
    name = F.concat_ws(" ~ ", "a", "b")
    out = out.unionByName(made(near, "strong_association", name, F.col("pmi") / 5, high(F.col("pmi") / 5 > 0.6))).unionByName(made(near, "association_rule", F.concat_ws(" -> ", "a", "b"), F.col("pmi") / 5, high(F.col("pmi") > 3)))
    of = lambda x: F.coalesce(F.try_divide(F.sum(F.when(F.col("label") == x, F.col("n"))), F.sum("n")), F.lit(0.0))
    mood = labels.agg(of("positive").alias("p"), of("negative").alias("q"))
    tone = F.when(F.col("p") > 0.5, "positive").when(F.col("q") > 0.3, "negative").otherwise("balanced")
    out = out.unionByName(made(mood, "sentiment", tone, F.when(F.col("p") > 0.5, F.col("p")).when(F.col("q") > 0.3, F.col("q")).otherwise(F.greatest("p", "q")), high((F.col("p") > 0.5) | (F.col("q") > 0.3))))
    two = top(clusters, 2, F.desc("size"), "label").select("label", "size", "share", F.split("words", " ").alias("w"))
    out = out.unionByName(made(top(two, 1, F.desc("size"), "label"), "main_cluster", F.col("label").cast("string"), F.col("share"), high(F.col("share") > 0.3)))
    both = two.agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), F.col("label").cast("string").alias("label"), "w"))).alias("c")).where(F.size("c") == 2)
    fives = [F.slice(F.col("c")[i]["w"], 1, 5) for i in (0, 1)]
    out = out.unionByName(made(both, "contrast", F.concat_ws(" / ", F.col("c")[0]["label"], F.col("c")[1]["label"]), F.try_divide(F.size(F.array_except(*fives)), F.size(fives[0])), F.lit("medium")))
    rise = (F.col("recent") - F.col("earlier")) / F.col("earlier") * 100
    out = out.unionByName(made(top(hot.where("earlier > 0").withColumn("rise", rise).where("rise > 0"), 5, F.desc("rise"), "entity"), "trend", F.col("entity"), F.col("rise") / 200, high(F.col("rise") > 100)))
    out = out.unionByName(made(top(shifts, 3, "entity", "date"), "sentiment_shift", F.concat_ws(" ", "entity", F.to_date("date").cast("string")), F.lit(0.7), F.lit("high")))
    return out.where("score IS NOT NULL").orderBy(F.desc(F.round("score", 9)), "kind", "subject").limit(most)


def hot_topics(mentions: DataFrame, recent: int = 7, over: float = 100.0) -> DataFrame:
    """(entity, recent, earlier, increase_pct) of the entities whose mean of the last days rose by more than so many per
    cent; mentions is (entity, date, value)."""
    both = S.recent_against_earlier(mentions, recent).where("earlier > 0")
    return both.withColumn("increase_pct", (F.col("recent") - F.col("earlier")) / F.col("earlier") * 100).where(F.col("increase_pct") > over)


def profiles(entities: DataFrame, relations: DataFrame, events: DataFrame, themes: DataFrame, most: int = 10, most_themes: int = 5) -> DataFrame:
    """Entities (entity_id, name, kind, n_attributes) with the names behind the ids that relations (subject_id, object_id,
    predicate), events (event_id, summary, entity_id, role) and themes (theme_id, name, entity_id) give: lists of related
    entities, events and themes, and an importance. Lists are cut to the first of each by name after they are counted."""
    known = entities.where(F.length("name") >= 2)
    out_ = relations.select(F.col("subject_id").alias("entity_id"), F.col("object_id").alias("other"), "predicate", F.lit("out").alias("direction"))
    both = out_.unionByName(relations.select(F.col("object_id").alias("entity_id"), F.col("subject_id").alias("other"), "predicate", F.lit("in").alias("direction"))).where("entity_id IS NOT NULL AND other IS NOT NULL")
    named = both.join(entities.select(F.col("entity_id").alias("other"), F.col("name").alias("other_name")), "other", "left").withColumn("related", F.concat_ws(" ", F.coalesce("predicate", F.lit("related")), "direction", F.coalesce("other_name", F.col("other").cast("string"))))

    def listed(df: DataFrame, item: str, to: str, k: int) -> DataFrame:
        counted = df.groupBy("entity_id", item).agg(F.count("*").alias("k"))  # a hub's repeats are one before they are listed
        w = Window.partitionBy("entity_id").orderBy(item)
        ranked = counted.withColumn("r", F.row_number().over(w)).groupBy("entity_id").agg(F.sum("k").alias(f"n_{to}"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= k, F.col(item)))), "; ").alias(to))
        return ranked

    parts = [listed(named, "related", "related", most), listed(events.withColumn("event", F.concat_ws(" ", F.coalesce("role", F.lit("takes part")), F.substring("summary", 1, 100))), "event", "events", most), listed(themes, "name", "themes", most_themes)]
    for p in parts:
        known = known.join(p, "entity_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return known.select("entity_id", "name", "kind", "related", "events", "themes", (zero("n_attributes") + zero("n_related") + zero("n_events") + 1).cast("long").alias("importance"))


def display_names(text: str) -> dict[str, str]:
    """Display names by field from a pasted description: a table whose heading names both columns, or lines of a field, a
    sign and a name. A description is a page of text: driver work."""
    lines = text.strip().split("\n")
    for i, line in enumerate(lines):
        if any(h in line for h in TABLE_HEADINGS):
            heads = line.split()
            at = [next((j for j in reversed(range(len(heads))) if any(h in heads[j] for h in wanted)), -1) for wanted in (DESIGN_HEADINGS, (NAME_HEADING,))]
            if min(at) >= 0:
                cells = (row.split() for row in lines[i + 1 :])
                return {c[at[0]]: c[at[1]] for c in cells if len(c) > max(at)}
    out = {}
    for line in lines:
        for sign in SIGNS:
            if sign in line:
                key, name = (x.strip() for x in line.split(sign, 1))
                if name and len(key) > 1:
                    out[key] = name
                    break
    return out


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df under its display names; a name that is taken keeps its field's name behind it."""
    out = {}
    for c in df.columns:
        name = re.sub(r"\s+", " ", names.get(c, c))
        out[c] = name if name not in out.values() else f"{name} ({c})"
    return df.select(*[F.col(c).alias(n) for c, n in out.items()])
