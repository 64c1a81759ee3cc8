"""Entities through time: mentions and feeling by day, hot days and what is named beside them, turns of feeling, topics.

Mentions are (doc_id, entity), documents carry a date and a score of feeling; both are brought to a row an entity and day
before any window, so windows run over days, not over mentions. A day's other entities meet a peak by a join on the day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.tables import settle


def daily_mentions(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, date, n, feeling): mentions of each entity on each day and the mean score of their documents; docs is
    (doc_id, date, score). Documents without a date are left out."""
    dated = docs.where("date IS NOT NULL").select("doc_id", "date", "score")
    return mentions.join(dated, "doc_id").groupBy("entity", "date").agg(F.count("*").alias("n"), F.avg("score").alias("feeling"))


def hot_peaks(daily: DataFrame, over: float = 2.0, beside: float = 1.5, least_days: int = 3) -> DataFrame:
    """(entity, date, n, mean, feeling): days of over `over` times an entity's mean whose neighbours among its days are not
    over `beside` times it; entities of at least so many days."""
    every, order = Window.partitionBy("entity"), Window.partitionBy("entity").orderBy("date")
    marked = daily.withColumns({"mean": F.avg("n").over(every), "days": F.count("*").over(every), "before": F.coalesce(F.lag("n").over(order), F.lit(0)), "after": F.coalesce(F.lead("n").over(order), F.lit(0))})
    hit = (F.col("days") >= least_days) & (F.col("n") > over * F.col("mean")) & (F.col("before") <= beside * F.col("mean")) & (F.col("after") <= beside * F.col("mean"))
    return marked.where(hit).select("entity", "date", "n", "mean", "feeling")


def beside_peaks(peaks: DataFrame, daily: DataFrame, k: int = 5) -> DataFrame:
    """(entity, other, days, n, rank): entities named on an entity's peak days, by the number of those days and of
    mentions on them, the k first. A day's entities are counted by day already; the join is on the day."""
    days = peaks.select(F.col("entity").alias("peak"), "date")
    met = daily.select("entity", "date", "n").join(days, "date").where("entity <> peak")
    by = met.groupBy(F.col("peak").alias("entity"), F.col("entity").alias("other")).agg(F.count("*").alias("days"), F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("days"), F.desc("n"), "other"))
    return by.withColumn("rank", rank).where(F.col("rank") <= k)


def chains(peaks: DataFrame, daily: DataFrame, most: int = 5, k: int = 5) -> DataFrame:
    """(entity, peaks, beside): the entities of most peaks, their peak days in order, and what is named beside them."""
    peaks = settle(peaks)
    top = peaks.groupBy("entity").agg(F.count("*").alias("n_peaks"), F.array_join(F.transform(F.array_sort(F.collect_list("date")), lambda d: F.date_format(d, "yyyy-MM-dd")), " ").alias("peaks")).orderBy(F.desc("n_peaks"), "entity").limit(most)
    near = beside_peaks(peaks, daily, k).groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]), " ").alias("beside"))
    return top.join(near, "entity", "left").select("entity", "n_peaks", "peaks", F.coalesce("beside", F.lit("")).alias("beside"))


def feeling_days(docs: DataFrame) -> DataFrame:
    """(date, n, feeling, good, bad): mean score by day and the shares of documents over and under 0."""
    return docs.where("date IS NOT NULL AND score IS NOT NULL").groupBy("date").agg(F.count("*").alias("n"), F.avg("score").alias("feeling"), F.avg((F.col("score") > 0).cast("double")).alias("good"), F.avg((F.col("score") < 0).cast("double")).alias("bad"))


def turning_points(days: DataFrame, step: float = 0.3, back: float = 0.2, by: list[str] = (), places: int = 9) -> DataFrame:
    """Days whose feeling is more than `step` over (under) the day before and more than `back` over (under) the next one;
    `by` names columns that tell series apart. One series of days is a window over its days."""
    order = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy("date")
    up, down = F.round(F.col("feeling") - F.lag("feeling").over(order), places), F.round(F.col("feeling") - F.lead("feeling").over(order), places)
    marked = days.withColumns({"up": up, "down": down})
    turn = F.when((F.col("up") > step) & (F.col("down") > back), "rise").when((F.col("up") < -step) & (F.col("down") < -back), "fall")
    return marked.withColumn("turn", turn).where("turn IS NOT NULL").drop("up", "down")


def heat_map(daily: DataFrame, unit: str = "week", most: int = 20) -> DataFrame:
    """(entity, period, n, heat): mentions by period of the entities of most mentions; heat is the share of the entity's
    hottest period."""
    by = settle(daily.groupBy("entity", F.date_trunc(unit, "date").alias("period")).agg(F.sum("n").alias("n")))
    top = by.groupBy("entity").agg(F.sum("n").alias("all"), F.max("n").alias("top")).orderBy(F.desc("all"), "entity").limit(most)
    return by.join(F.broadcast(top), "entity").select("entity", "period", "n", (F.col("n") / F.col("top")).alias("heat"))


def topic_shares(mentions: DataFrame, topics: DataFrame) -> DataFrame:
    """(entity, topic, n, probability): how an entity's mentions fall to the topics of their documents; topics is
    (doc_id, topic). Documents without a topic count for none."""
    by = mentions.join(topics.where("topic IS NOT NULL").select("doc_id", "topic"), "doc_id").groupBy("entity", "topic").agg(F.count("*").alias("n"))
    return by.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("entity")))


def profiles(mentions: DataFrame, docs: DataFrame, topics: DataFrame, pairs: DataFrame, k: int = 5) -> DataFrame:
    """(entity, n, n_docs, first, last, feeling, topics, related): where an entity is named, between which days, with what
    feeling, its likeliest topics, and its strongest partners; pairs is (a, b, n)."""
    base = mentions.join(docs.select("doc_id", "date", "score"), "doc_id").groupBy("entity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.min("date").alias("first"), F.max("date").alias("last"), F.avg("score").alias("feeling"))

    def listed(df: DataFrame, order: list, item: str, to: str) -> DataFrame:
        ranked = df.withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy(*order))).where(F.col("r") <= k)
        return ranked.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", item))), lambda x: x[item]), ", ").alias(to))

    shares = topic_shares(mentions, topics).withColumn("said", F.concat(F.col("topic").cast("string"), F.lit(" "), F.format_number(F.col("probability") * 100, 0), F.lit("%")))
    both = pairs.select(F.col("a").alias("entity"), F.col("b").alias("other"), "n").unionByName(pairs.select(F.col("b").alias("entity"), F.col("a").alias("other"), "n"))
    out = base.join(listed(shares, [F.desc("n"), F.asc("topic")], "said", "topics"), "entity", "left")
    return out.join(listed(both, [F.desc("n"), F.asc("other")], "other", "related"), "entity", "left")
