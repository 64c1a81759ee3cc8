"""Nearest neighbours through coarse cells, and what is made of them: predictions and spectral clusters.

Cell centres come from k-means on a bounded sample; every row is in the cell of its nearest centre, and every query asks
the PROBES nearest cells. Cells meet as tiles: at most BLOCK rows of a cell against at most BLOCK queries of it, in NumPy,
so a cell that holds a third of all rows is many tasks and no task holds it whole. Each tile keeps its k best by query and
the rest is a window over those. Distances are exact; what a search can miss is a neighbour in a cell not asked, and
`recall` measures that against all rows.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, PowerIterationClustering
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.tables import settle

#: Rows that centres are fitted on, centres, cells asked, rows and queries of a tile.
SAMPLE, CELLS, PROBES, BLOCK = 20_000, 256, 8, 2048


def vectors(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(id, v) of rows without null in cols: an array column as it is, or several numbers."""
    made = F.col(cols[0]).cast("array<double>") if len(cols) == 1 and df.schema[cols[0]].dataType.typeName() == "array" else F.array(*[F.col(c).cast("double") for c in cols])
    return df.select(F.col(key).alias("id"), made.alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def centres(rows: DataFrame, cells: int = CELLS, sample: int = SAMPLE, seed: int = 42) -> np.ndarray:
    """At most so many centres, about the root of the number of rows, fitted on rows drawn by hash."""
    n = rows.count()
    if not n:
        return np.zeros((0, 0))
    draw = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30))
    k = min(cells, ceil(sqrt(n) / 2))
    if k < 2:
        return np.zeros((1, rows.select(F.size("v")).first()[0]))
    fitted = KMeans(k=k, seed=seed, maxIter=10).fit((draw if draw.limit(k).count() == k else rows).select(array_to_vector("v").alias("features")))
    return np.array(fitted.clusterCenters())


def in_cells(rows: DataFrame, middle: np.ndarray, probes: int = 1) -> DataFrame:
    """rows with `cell`, a row for each of the nearest `probes` centres."""
    far_is = (middle**2).sum(axis=1)

    def run(parts):
        for pdf in parts:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy())
            far = far_is - 2 * x @ middle.T
            near = np.argsort(far, axis=1, kind="stable")[:, :probes]
            yield pdf.loc[pdf.index.repeat(near.shape[1])].assign(cell=near.ravel().astype("int32"))

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, cell int")


def _dealt(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """rows with `part`, about `block` of a cell in each; and the parts of each cell, a row a cell."""
    sizes = rows.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("parts"))
    return rows.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")).drop("parts"), sizes


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, cells: int = CELLS, probes: int = PROBES, block: int = BLOCK, itself: bool = False) -> DataFrame:
    """(query, rank, id, distance): the k nearest rows of each query among the cells asked; rows and queries are (id, v).
    Ties go by the least id; a row is no neighbour of the query of the same id unless `itself`."""
    middle = centres(rows, cells)
    kind = rows.schema["id"].dataType.simpleString()
    out = f"query {queries.schema['id'].dataType.simpleString()}, id {kind}, distance double"
    if not len(middle):
        return rows.sparkSession.createDataFrame([], out).select("query", F.lit(1).alias("rank"), "id", "distance")
    held, row_parts = _dealt(settle(in_cells(rows, middle)), block)
    asked, query_parts = _dealt(settle(in_cells(queries, middle, min(probes, len(middle)))), block)
    # every part of a cell's rows meets every part of its queries
    left = held.withColumnRenamed("part", "row_part").join(F.broadcast(query_parts), "cell").withColumn("query_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = asked.withColumnRenamed("part", "query_part").join(F.broadcast(row_parts), "cell").withColumn("row_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": b["id"][:0], "id": a["id"][:0], "distance": np.zeros(0)})
        a = a.sort_values("id", ignore_index=True)
        x, ids = np.stack(a["v"].to_numpy()), a["id"].to_numpy()
        found = []
        for q, v in zip(b["id"].to_numpy(), b["v"].to_numpy(), strict=True):
            far = np.sqrt(((x - v) ** 2).sum(axis=1))
            far[ids == q] = far[ids == q] if itself else np.inf
            best = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1]) if len(far) > k else np.arange(len(far))
            best = best[np.argsort(far[best], kind="stable")][:k]
            found.append(pd.DataFrame({"query": q, "id": ids[best], "distance": far[best]}))
        every = pd.concat(found, ignore_index=True)
        return every[np.isfinite(every["distance"])]

    keys = ["cell", "row_part", "query_part"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(tile, out)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "distance")


def recall(rows: DataFrame, queries: DataFrame, found: DataFrame, k: int = 10, block: int = BLOCK) -> float:
    """The share of the k nearest among all rows that were found: one cell that all are in, met in tiles."""
    exact = nearest(rows, queries, k, cells=1, probes=1, block=block)
    r = exact.join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share")).first()
    return r.share or 0.0


def predict(train: DataFrame, rows: DataFrame, k: int = 5, number: bool = False, **search) -> DataFrame:
    """(query, prediction, confidence) of rows (id, v) from train (id, v, label): the label of most of the k nearest, the
    least among equals, and its share; or the mean of a number and the share of neighbours within a deviation of it."""
    near = nearest(train.select("id", "v"), rows, k, **search).join(train.select("id", "label"), "id")
    if number:
        return near.groupBy("query").agg(F.avg("label").alias("prediction"), F.stddev_pop("label").alias("deviation"))
    votes = near.groupBy("query", "label").agg(F.count("*").alias("n"))
    best = votes.groupBy("query").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("label").alias("label"))).alias("top"), F.sum("n").alias("all"))
    return best.select("query", F.col("top.label").alias("prediction"), (-F.col("top.n") / F.col("all")).alias("confidence"))


def affinities(rows: DataFrame, k: int = 10, **search) -> DataFrame:
    """(src, dst, weight): each row and its k nearest, so at most k links a row, weighted by closeness against the mean
    distance of all links."""
    near = settle(nearest(rows, rows, k, **search))
    scale = near.agg(F.greatest(F.lit(1e-12), F.avg(F.col("distance") ** 2)).alias("s"))
    links = near.select(F.least("query", "id").alias("src"), F.greatest("query", "id").alias("dst"), "distance").groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    return links.join(F.broadcast(scale)).select("src", "dst", F.exp(-F.col("distance") ** 2 / F.col("s")).alias("weight"))


def spectral(rows: DataFrame, clusters: int, k: int = 10, rounds: int = 30, **search) -> DataFrame:
    """(id, cluster) by power iteration on the affinities; ids are whole numbers. Clusters are numbered from 0 by their
    least id."""
    links = settle(affinities(rows, k, **search).where("weight > 0"))
    made = settle(PowerIterationClustering(k=clusters, maxIter=rounds, initMode="degree", srcCol="src", dstCol="dst", weightCol="weight").assignClusters(links).select("id", "cluster"))
    least = made.groupBy("cluster").agg(F.min("id").alias("first")).withColumn("number", F.row_number().over(Window.orderBy("first")) - 1)
    return made.join(F.broadcast(least), "cluster").select("id", F.col("number").alias("cluster"))
