"""Support vector regression: a linear model whose loss starts beyond epsilon.

Loss: half the squared length of the weights (without the shift) plus `cost` times the sum of squared excesses over
epsilon. A round is one pass: tasks add up gradients in NumPy, a vector a task, summed by position in Spark; L-BFGS on the
driver sees one small vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tables import settle


@dataclass
class Regressor:
    weights: np.ndarray
    shift: float
    loss: float
    rounds: int

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows (v, ...) with `prediction`."""
        dot = F.aggregate(F.zip_with("v", F.array(*map(F.lit, self.weights.tolist())), lambda a, b: a * b), F.lit(self.shift), lambda a, b: a + b)
        return rows.withColumn("prediction", dot)


def _sums(rows: DataFrame, x: np.ndarray, epsilon: float) -> np.ndarray:
    """Gradient by weight, then by shift, then the loss, over all rows."""

    def run(parts):
        total = np.zeros(len(x) + 1)
        for pdf in parts:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy())
                off = v @ x[:-1] + x[-1] - pdf["label"].to_numpy()
                over = np.sign(off) * np.maximum(0.0, np.abs(off) - epsilon)
                total[:-2] += 2 * over @ v
                total[-2] += 2 * over.sum()
                total[-1] += (over**2).sum()
        yield pd.DataFrame({"at": np.arange(len(total)), "x": total})

    got = rows.mapInPandas(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(x) + 1)
    for r in got:
        out[r["at"]] = r["x"]
    return out


def fit(rows: DataFrame, epsilon: float = 0.1, cost: float = 1.0, rounds: int = 60, memory: int = 8, close: float = 1e-7) -> Regressor:
    """Fits rows (v, label), written once."""
    rows = settle(rows.select("v", F.col("label").cast("double").alias("label")).where("v IS NOT NULL AND label IS NOT NULL"))
    first = rows.select(F.size("v").alias("k")).first()
    if first is None:
        raise ValueError("no rows")

    def loss(x):
        sums = _sums(rows, x, epsilon)
        return float(0.5 * x[:-1] @ x[:-1] + cost * sums[-1]), cost * sums[:-1] + np.append(x[:-1], 0.0)

    x = np.zeros(first.k + 1)
    x[-1] = rows.agg(F.avg("label")).first()[0]
    value, slope = loss(x)
    past, done = [], 0
    for done in range(1, rounds + 1):
        d = -slope
        marks = []
        for s, y in reversed(past):
            marks.append(a := s @ d / (s @ y))
            d = d - a * y
        if past:
            s, y = past[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(marks), strict=True):
            d = d + s * (a - y @ d / (s @ y))
        step = 1.0 if past else 1.0 / max(1e-12, float(np.abs(slope).sum()))
        for _ in range(30):
            new, new_slope = loss(x + step * d)
            if new <= value + 1e-4 * step * (slope @ d):
                break
            step /= 2
        else:
            break
        s, y = step * d, new_slope - slope
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y)]
        gain, x, value, slope = value - new, x + s, new, new_slope
        if gain <= close * max(1.0, abs(value)):
            break
    return Regressor(x[:-1], float(x[-1]), value, done)
