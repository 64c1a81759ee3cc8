"""AdaBoost (SAMME) over shallow trees: every round fits a tree to the rows' weights and raises those it got wrong."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tables import settle


@dataclass
class Boosted:
    """Trees with their weights; classes are numbers from 0."""

    classes: int
    trees: list[DecisionTreeClassificationModel] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows (features, ...) with `prediction`, the class of most weight, and `confidence`, its share."""
        out, names = rows, []
        for k, tree in enumerate(self.trees):
            names.append(f"_t{k}")
            tree = tree.copy().setPredictionCol(names[-1]).setRawPredictionCol("").setProbabilityCol("")
            out = tree.transform(out)
        votes = [sum((F.when(F.col(n) == c, w).otherwise(0.0) for n, w in zip(names, self.weights, strict=True)), F.lit(0.0)) for c in range(self.classes)]
        out = out.withColumn("_votes", F.array(*votes)).drop(*names)
        top = F.array_max("_votes")
        return out.withColumns({"prediction": (F.array_position("_votes", top) - 1).cast("double"), "confidence": top / F.lit(sum(self.weights) or 1.0)}).drop("_votes")


def adaboost(rows: DataFrame, rounds: int = 20, depth: int = 1, rate: float = 1.0, seed: int = 42) -> Boosted:
    """Fits rows (features, label); labels are 0.0, 1.0, ... Weights are a column that is written each round, so a lost
    executor costs a task and lineage stays short; only weighted errors reach the driver. Ends early when a tree is no
    better than chance or makes no error."""
    held = rows.select("features", "label", F.lit(1.0).alias("w"))
    first = held.agg(F.max("label").alias("top"), F.count("*").alias("n")).first()
    if not first.n:
        raise ValueError("no rows")
    classes = int(first.top) + 1
    held = settle(held.withColumn("w", F.lit(1.0 / first.n)))
    made = Boosted(classes)
    for k in range(rounds):
        tree = DecisionTreeClassifier(maxDepth=depth, weightCol="w", featuresCol="features", labelCol="label", seed=seed + k).fit(held)
        judged = tree.transform(held).withColumn("miss", (F.col("prediction") != F.col("label")).cast("double"))
        r = judged.agg(F.sum(F.col("w") * F.col("miss")).alias("bad"), F.sum("w").alias("all")).first()
        error = r.bad / r["all"]
        if error >= 1 - 1 / classes and made.trees:
            break
        weight = rate * (math.log(max(1e-10, 1 - error) / max(1e-10, error)) + math.log(max(1, classes - 1)))
        made.trees.append(tree)
        made.weights.append(max(weight, 1e-10))
        if error <= 1e-10 or error >= 1 - 1 / classes:
            break
        scale = 1 / (r["all"] - r.bad + r.bad * math.exp(weight))  # the weights' sum is 1 again
        held = settle(judged.select("features", "label", (F.col("w") * F.exp(F.lit(weight) * F.col("miss")) * scale).alias("w")))
    return made
