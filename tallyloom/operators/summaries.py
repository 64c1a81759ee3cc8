"""Clusters from summaries: rows become a bounded number of clustering features, which a tree of merges brings together.

A clustering feature is a number of rows, the sum of their vectors and the sum of their squared lengths: from it follow
centre and spread, and two are merged by adding. A task reads its rows once and holds at most MOST features: a row joins
the nearest one if the spread stays within a limit, else makes one of its own; when there are too many, the limit grows
and features merge. Features of tasks are merged FAN tasks at a time until one set is left; Ward's merges, weighted by
rows, make the clusters of it, and every row goes to the nearest centre.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tables import settle

#: Features a task holds, and tasks whose features are merged in one.
MOST, FAN = 256, 16
FEATURES = "n double, total array<double>, squares double"


class Features:
    """n, total and squares of at most `most` clustering features; reach is the greatest squared spread of a merge."""

    def __init__(self, most: int = MOST):
        self.most, self.reach = most, 0.0
        self.n, self.total, self.squares = np.zeros(0), np.zeros((0, 0)), np.zeros(0)

    @staticmethod
    def spread(n, total, squares):
        """Mean squared distance from the centre."""
        return np.maximum(0.0, squares / n - ((total / n[..., None]) ** 2).sum(axis=-1))

    def add(self, n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> None:
        """Takes in features, or rows (n = 1), a block at a time."""
        for at in range(0, len(n), self.most):
            self._block(n[at : at + self.most], total[at : at + self.most], squares[at : at + self.most])

    def _block(self, n, total, squares) -> None:
        if len(self.n):
            middle = self.total / self.n[:, None]
            x = total / n[:, None]
            near = ((middle**2).sum(axis=1) - 2 * x @ middle.T).argmin(axis=1)
            together = self.spread(self.n[near] + n, self.total[near] + total, self.squares[near] + squares)
            joins = together <= self.reach
            np.add.at(self.n, near[joins], n[joins])
            np.add.at(self.total, near[joins], total[joins])
            np.add.at(self.squares, near[joins], squares[joins])
            n, total, squares = n[~joins], total[~joins], squares[~joins]
        self.n, self.squares = np.concatenate([self.n, n]), np.concatenate([self.squares, squares])
        self.total = np.concatenate([self.total, total]) if self.total.size else total.copy()
        while len(self.n) > self.most:
            self._shrink()

    def _shrink(self) -> None:
        """Each feature is offered to the nearest of those before it; the limit is what a fifth of them need."""
        middle = self.total / self.n[:, None]
        far = ((middle[:, None] - middle[None]) ** 2).sum(axis=2) if len(middle) <= 600 else (middle**2).sum(axis=1)[None] - 2 * middle @ middle.T + (middle**2).sum(axis=1)[:, None]
        np.fill_diagonal(far, np.inf)
        near = far.argmin(axis=1)
        need = self.spread(self.n + self.n[near], self.total + self.total[near], self.squares + self.squares[near])
        self.reach = max(self.reach, float(np.quantile(need, 0.2)))
        gone = np.zeros(len(self.n), dtype=bool)
        for i in np.argsort(need, kind="stable").tolist():
            j = int(near[i])
            if need[i] > self.reach or gone[i] or gone[j]:
                continue
            self.n[j] += self.n[i]
            self.total[j] += self.total[i]
            self.squares[j] += self.squares[i]
            gone[i] = True
        self.n, self.total, self.squares = self.n[~gone], self.total[~gone], self.squares[~gone]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"n": self.n, "total": list(self.total), "squares": self.squares})


def summarise(rows: DataFrame, most: int = MOST, fan: int = FAN) -> Features:
    """The clustering features of rows (v array<double>), merged in a tree; at most `most` reach the driver."""

    def read(parts):
        held = Features(most)
        for pdf in parts:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                held.add(np.ones(len(x)), x, (x**2).sum(axis=1))
        if len(held.n):
            yield held.frame()

    def merge(parts):
        held = Features(most)
        for pdf in parts:
            if len(pdf):
                held.add(pdf["n"].to_numpy(), np.stack(pdf["total"].to_numpy()), pdf["squares"].to_numpy())
        if len(held.n):
            yield held.frame()

    made = settle(rows.select("v").mapInPandas(read, FEATURES).withColumn("_p", F.spark_partition_id()))
    while (width := (made.agg(F.max("_p")).first()[0] or 0) + 1) > 1:
        few = max(1, -(-width // fan))
        made = settle(made.withColumn("_to", (F.col("_p") / fan).cast("int")).repartition(few, "_to").drop("_p", "_to").mapInPandas(merge, FEATURES).withColumn("_p", F.spark_partition_id()))
    last = made.toPandas()
    held = Features(most)
    if len(last):
        held.add(last["n"].to_numpy(), np.stack(last["total"].to_numpy()), last["squares"].to_numpy())
    return held


def ward(n: np.ndarray, middle: np.ndarray, clusters: int) -> np.ndarray:
    """A cluster number for each weighted centre: the two whose merge adds least to the squares within go together until
    so many are left. Clusters are numbered by their first centre."""
    n, middle, of = n.astype(float).copy(), middle.copy(), np.arange(len(n))
    alive = np.ones(len(n), dtype=bool)
    cost = ((middle[:, None] - middle[None]) ** 2).sum(axis=2) * (n[:, None] * n[None]) / (n[:, None] + n[None])
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(n) - clusters):
        i, j = sorted(divmod(int(cost.argmin()), len(n)))
        middle[i] = (n[i] * middle[i] + n[j] * middle[j]) / (n[i] + n[j])
        n[i] += n[j]
        alive[j], of[of == j] = False, i
        cost[j], cost[:, j] = np.inf, np.inf
        row = ((middle - middle[i]) ** 2).sum(axis=1) * n * n[i] / (n + n[i])
        row[~alive] = np.inf
        row[i] = np.inf
        cost[i], cost[:, i] = row, row
    return np.unique(of, return_inverse=True)[1]


def centres(features: Features, clusters: int) -> np.ndarray:
    of = ward(features.n, features.total / features.n[:, None], min(clusters, len(features.n)))
    k = int(of.max()) + 1
    weight = np.bincount(of, weights=features.n, minlength=k)
    return np.stack([np.bincount(of, weights=c, minlength=k) for c in features.total.T], axis=1) / weight[:, None]


def assign(rows: DataFrame, middle: np.ndarray) -> DataFrame:
    """rows (v, ...) with the number of the nearest centre."""
    nearest = F.pandas_udf(lambda v: pd.Series(((middle**2).sum(axis=1) - 2 * np.stack(v.to_numpy()) @ middle.T).argmin(axis=1).astype("int32") if len(v) else np.zeros(0, "int32")), "int")
    return rows.withColumn("cluster", nearest("v"))


def birch(rows: DataFrame, clusters: int = 3, most: int = MOST) -> DataFrame:
    """rows (v, ...) with `cluster`, in one pass for the features and one for the rows."""
    held = summarise(rows, most)
    return assign(rows, centres(held, clusters)) if len(held.n) else rows.withColumn("cluster", F.lit(0))


def reduced(vectors: DataFrame, col: str, size: int = 20, more: int = 50, least: float = 0.6) -> DataFrame:
    """vectors with `v`: standardised and brought to `size` principal components, to `more` where those hold less than
    `least` of the variance."""
    held = vectors.withColumn("_v", array_to_vector(F.col(col).cast("array<double>")))
    width = held.select(F.size(col).alias("k")).first()["k"]
    scaler = StandardScaler(inputCol="_v", outputCol="_s", withMean=True).fit(held)
    scaled = scaler.transform(held)
    fitted = PCA(k=min(more, width), inputCol="_s", outputCol="_p").fit(scaled)
    share = fitted.explainedVariance.toArray()
    keep = min(size, width) if share[:size].sum() >= least else min(more, width)
    return fitted.transform(scaled).withColumn("v", F.slice(vector_to_array("_p"), 1, keep)).drop("_v", "_s", "_p")


def ward_clusters(rows: DataFrame, most_clusters: int = 10, most: int = MOST) -> tuple[DataFrame, dict[int, float]]:
    """rows (v, ...) with `cluster`, by Ward's merges of the features; the number of clusters, 2 to most_clusters, is that
    of best silhouette. Also the silhouettes. All numbers are cuts of the same tree, over the same features."""
    held = summarise(rows, most)
    rate = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    rows = settle(rows)
    vectors = rows.withColumn("features", array_to_vector("v"))
    found, rated = {}, {}
    for k in range(2, min(most_clusters, len(held.n) - 1) + 1):
        found[k] = centres(held, k)
        with_k = assign(vectors, found[k])
        rated[k] = rate.evaluate(with_k.select("features", "cluster")) if with_k.select("cluster").distinct().count() > 1 else -1.0
    if not rated:
        return rows.withColumn("cluster", F.lit(0)), {}
    best = max(rated, key=lambda k: (round(rated[k], 9), -k))
    return assign(rows, found[best]), rated


def cluster_profile(rows: DataFrame, key: str) -> DataFrame:
    """(cluster, size, share, nearest) of rows (key, v, cluster): the row nearest to each cluster's centre, the least key
    among equals; centres are means, a row a cluster."""
    flat = rows.select("cluster", F.posexplode("v").alias("at", "x"))
    middle = flat.groupBy("cluster", "at").agg(F.avg("x").alias("m")).groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "m"))), lambda c: c["m"]).alias("middle"))
    far = F.aggregate(F.zip_with("v", "middle", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    total = F.broadcast(rows.agg(F.count("*").alias("all")))
    by = rows.join(F.broadcast(middle), "cluster").groupBy("cluster").agg(F.count("*").alias("size"), F.min(F.struct(F.round(far, 9).alias("far"), F.col(key).alias("key"))).alias("near"))
    return by.join(total).select("cluster", "size", (F.col("size") / F.col("all")).alias("share"), F.col("near.key").alias("nearest"))
