"""Frequent itemsets of any size and the rules they carry, by frequent-pattern trees."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tables import settle


def baskets(df: DataFrame, key: list[str], item: str) -> DataFrame:
    """(key, items): each basket's different items; nulls are none. A basket's items are gathered in one row."""
    return df.where(F.col(item).isNotNull()).groupBy(*key).agg(F.sort_array(F.collect_set(F.col(item).cast("string"))).alias("items"))


def frequent(sets: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """(items, size, n): itemsets of at most `most` items that `least` baskets or more hold; items in order.

    Items that are in too few baskets leave first, so trees are grown over frequent ones alone; they are grown by item,
    spread over all tasks. `sets` (items) is read twice.
    """
    n = sets.count()
    if n < max(1, least):
        return sets.sparkSession.createDataFrame([], "items array<string>, size int, n long")
    # the share that just `least` baskets reach, without a rounding above it
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / n), minConfidence=0.0).fit(sets.select("items"))
    out = model.freqItemsets.select(F.sort_array("items").alias("items"), F.size("items").alias("size"), F.col("freq").alias("n"))
    return out.where(F.col("size") <= most) if most else out


def rules(found: DataFrame, n_baskets: int, confidence: float = 0.5, lift: float = 1.0) -> DataFrame:
    """(antecedent, consequent, n, support, confidence, lift) with one item as consequent, of any size, from frequent
    itemsets: each set and each of its items met with the set without it and with the item alone."""
    found = settle(found)
    parts = found.where("size > 1").withColumn("consequent", F.explode("items")).withColumn("antecedent", F.array_remove("items", F.col("consequent")))
    alone = found.where("size = 1").select(F.col("items")[0].alias("consequent"), F.col("n").alias("n_consequent"))
    met = parts.join(found.select(F.col("items").alias("antecedent"), F.col("n").alias("n_antecedent")), "antecedent").join(alone, "consequent")
    rated = met.select("antecedent", "consequent", "n", (F.col("n") / n_baskets).alias("support"), (F.col("n") / F.col("n_antecedent")).alias("confidence"), (F.col("n") / F.col("n_antecedent") * n_baskets / F.col("n_consequent")).alias("lift"))
    return rated.where((F.col("confidence") >= confidence) & (F.col("lift") >= lift))


def closed(found: DataFrame) -> DataFrame:
    """Itemsets without a larger one that as many baskets hold."""
    found = settle(found)
    below = found.where("size > 1").select(F.explode("items").alias("x"), "items", "n").select(F.array_remove("items", F.col("x")).alias("items"), "n").distinct()
    return found.join(below, ["items", "n"], "left_anti")
