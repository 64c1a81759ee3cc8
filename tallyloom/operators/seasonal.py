"""Seasonal ARIMA by conditional sum of squares, a series a group.

Ordinary and seasonal differences come first; the ordinary and seasonal polynomials of each side are multiplied out, the
residuals follow by recursion from zeros, and Levenberg and Marquardt's steps lower their squares. A series has a row a
date, so a group is bounded by its dates; missing dates between the first and the last are filled by straight lines
before the fit, and their number is told.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: A fit needs so many values beyond its parameters and lags.
SPARE = 10


@dataclass
class Fit:
    order: tuple[int, int, int]
    seasonal: tuple[int, int, int, int]
    x: np.ndarray  # ar, ma, seasonal ar, seasonal ma
    mean: float
    variance: float

    def parts(self) -> tuple[np.ndarray, ...]:
        p, q, sp, sq = self.order[0], self.order[2], self.seasonal[0], self.seasonal[2]
        return tuple(np.split(self.x, np.cumsum([p, q, sp])))[:4] if len(self.x) == p + q + sp + sq else ()


def _multiplied(own: np.ndarray, seasonal: np.ndarray, s: int, sign: float) -> np.ndarray:
    """Coefficients of lags 1.. of (1 + sign sum own B^i)(1 + sign sum seasonal B^(s i)); rows are parameter vectors."""
    one = np.concatenate([np.ones((len(own), 1)), sign * own], axis=1)
    out = np.zeros((len(own), own.shape[1] + s * seasonal.shape[1] + 1))
    out[:, : one.shape[1]] = one
    for k in range(seasonal.shape[1]):
        at = s * (k + 1)
        out[:, at : at + one.shape[1]] += sign * seasonal[:, k : k + 1] * one
    return out[:, 1:]


def _lags(x: np.ndarray, order, seasonal) -> tuple[np.ndarray, np.ndarray]:
    p, q, sp, s = order[0], order[2], seasonal[0], seasonal[3]
    return -_multiplied(x[:, :p], x[:, p + q : p + q + sp], s, -1.0), _multiplied(x[:, p : p + q], x[:, p + q + sp :], s, 1.0)


def residuals(w: np.ndarray, x: np.ndarray, order, seasonal) -> np.ndarray:
    """For each row of parameters the residuals of w, from the first value with all its lags on."""
    ar, ma = _lags(x, order, seasonal)
    n, a, m = len(w), ar.shape[1], ma.shape[1]
    held = np.zeros((len(x), n + m))
    straight = np.tile(w[a:], (len(x), 1))
    for i in range(a):
        straight = straight - ar[:, i : i + 1] * w[a - 1 - i : n - 1 - i]
    if not m:
        return straight
    back = ma[:, ::-1]
    for t in range(straight.shape[1]):
        held[:, m + t] = straight[:, t] - (back * held[:, t : t + m]).sum(axis=1)
    return held[:, m : m + straight.shape[1]]


def differenced(y: np.ndarray, d: int, sd: int, s: int) -> np.ndarray:
    for _ in range(sd):
        y = y[s:] - y[:-s]
    for _ in range(d):
        y = np.diff(y)
    return y


def fit(values: np.ndarray, order=(1, 0, 0), seasonal=(1, 0, 0, 7), rounds: int = 60) -> Fit | None:
    """None where the series is too short."""
    k = order[0] + order[2] + seasonal[0] + seasonal[2]
    w = differenced(np.asarray(values, float), order[1], seasonal[1], seasonal[3])
    lags = order[0] + seasonal[0] * seasonal[3]
    if len(w) < lags + k + SPARE:
        return None
    mean = float(w.mean()) if not order[1] + seasonal[1] else 0.0
    w = w - mean
    x, damp = np.zeros(k), 1e-2
    e = residuals(w, x[None], order, seasonal)[0]
    for _ in range(rounds if k else 0):
        near = x + np.concatenate([np.zeros((1, k)), 1e-6 * np.eye(k)])
        rows = residuals(w, near, order, seasonal)
        slope = (rows[1:] - rows[0]) / 1e-6
        square, pull = slope @ slope.T, slope @ e
        while damp < 1e12:
            new = x - np.linalg.solve(square + damp * np.diag(np.maximum(1e-12, np.diag(square))), pull)
            tried = residuals(w, new[None], order, seasonal)[0]
            if np.isfinite(tried).all() and tried @ tried < e @ e:
                break
            damp *= 10
        else:
            break
        gain, x, e, damp = 1 - (tried @ tried) / (e @ e), new, tried, damp / 10
        if gain < 1e-10:
            break
    return Fit(tuple(order), tuple(seasonal), x, mean, float(e @ e / max(1, len(e))))


def forecast(values: np.ndarray, made: Fit, steps: int = 12) -> np.ndarray:
    y = np.asarray(values, float)
    d, sd, s = made.order[1], made.seasonal[1], made.seasonal[3]
    w = differenced(y, d, sd, s) - made.mean
    ar, ma = (c[0] for c in _lags(made.x[None], made.order, made.seasonal))
    e = np.concatenate([np.zeros(max(len(ar), len(ma)) + 1), residuals(w, made.x[None], made.order, made.seasonal)[0]])
    ww, ee = list(w), list(e)
    for _ in range(steps):
        ww.append(float(sum(c * ww[-1 - i] for i, c in enumerate(ar)) + sum(c * ee[-1 - i] for i, c in enumerate(ma))))
        ee.append(0.0)
    out = np.array(ww[len(w) :]) + made.mean
    half = differenced(y, 0, sd, s)  # differences are undone in the reverse order
    tails = [np.diff(half, k)[-1] for k in range(d)]
    for last in reversed(tails):
        out = last + np.cumsum(out)
    for level in reversed(range(sd)):
        past = list(differenced(y, 0, level, s)[-s:])
        for v in out.tolist():
            past.append(past[-s] + v)
        out = np.array(past[s:])
    return out


def regular(pdf: pd.DataFrame, freq: str = "D") -> tuple[np.ndarray, int]:
    """Values by date without gaps, and how many were filled."""
    s = pdf.set_index("date")["value"].astype(float).sort_index()
    full = s.asfreq(freq) if len(s) else s
    return full.interpolate().to_numpy(), int(full.isna().sum())


def sarima_fits(s: DataFrame, order=(1, 0, 0), seasonal=(1, 0, 0, 7), freq: str = "D") -> DataFrame:
    """(entity, n, filled, ar, ma, seasonal_ar, seasonal_ma, variance) of each series (entity, date, value); series that
    are too short have no row."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, filled = regular(pdf, freq)
        made = fit(x, order, seasonal)
        names = ["entity", "n", "filled", "ar", "ma", "seasonal_ar", "seasonal_ma", "variance"]
        rows = [(pdf["entity"].iloc[0], len(x), filled, *[c.tolist() for c in made.parts()], made.variance)] if made else []
        return pd.DataFrame(rows, columns=names)

    return s.groupBy("entity").applyInPandas(one, "entity string, n long, filled long, ar array<double>, ma array<double>, seasonal_ar array<double>, seasonal_ma array<double>, variance double")


def sarima_forecast(s: DataFrame, order=(1, 0, 0), seasonal=(1, 0, 0, 7), steps: int = 14, freq: str = "D") -> DataFrame:
    """(entity, k, forecast, filled) of each series, k periods after its last date."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, filled = regular(pdf, freq)
        made = fit(x, order, seasonal)
        f = forecast(x, made, steps) if made else np.zeros(0)
        return pd.DataFrame({"entity": pdf["entity"].iloc[0], "k": range(1, len(f) + 1), "forecast": f, "filled": filled})

    return s.groupBy("entity").applyInPandas(one, "entity string, k long, forecast double, filled long")
