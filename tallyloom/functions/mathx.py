"""Distribution tails and other mathematics for small results on the driver; no SciPy."""

from __future__ import annotations

import math

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's method for the continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 2000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for n in range(1, 2000):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def chi2_sf(x: float, dof: float) -> float:
    return gamma_upper(dof / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_two_sided(t: float, dof: float) -> float:
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t))


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution function, by bisection and Newton steps."""
    lo, hi = -40.0, 40.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - normal_sf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def pearson_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs."""
    if n < 3:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def k2(skew: float, kurtosis: float, n: int) -> tuple[float, float]:
    """D'Agostino and Pearson's K2 from population skew and excess kurtosis, and its p-value."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (b2 - 1))
    y = y / math.sqrt(2 / (w2 - 1))
    z1 = math.asinh(y) / math.sqrt(0.5 * math.log(w2))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurtosis + 3 - mean) / math.sqrt(var)
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + math.sqrt(1 + 4 / b1**2))
    low = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs(low) ** (1 / 3), low)) / math.sqrt(2 / (9 * a))
    stat = z1 * z1 + z2 * z2
    return stat, math.exp(-stat / 2)


def shapiro(sample: np.ndarray) -> tuple[float, float]:
    """Shapiro-Wilk W and p-value by Royston's approximation, for 12 to 5000 values."""
    x = np.sort(np.asarray(sample, float))
    n = len(x)
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u = 1 / math.sqrt(n)
    c = m / math.sqrt(m @ m)
    last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, c[-1]], u)
    before = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
    phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
    a = m / math.sqrt(phi)
    a[-1], a[-2], a[0], a[1] = last, before, -last, -before
    spread = float(((x - x.mean()) ** 2).sum())
    if spread == 0:
        return 1.0, 1.0
    w = (a @ x) ** 2 / spread
    log_n = math.log(n)
    mean = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n)
    scale = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log_n))
    return float(w), normal_sf((math.log(max(1e-300, 1 - w)) - mean) / scale)


def smallest_direction(cov: np.ndarray) -> tuple[float, np.ndarray]:
    """Least eigenvalue of a covariance matrix and its vector."""
    values, vectors = np.linalg.eigh(cov)
    return float(values[0]), vectors[:, 0]
