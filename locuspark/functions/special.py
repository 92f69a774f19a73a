"""Tails of distributions for NumPy arrays, in tasks and on the driver."""

from __future__ import annotations

import math

import numpy as np


def incomplete_beta(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    x = np.asarray(x, float)
    mirror = x > (a + 1.0) / (a + b + 2.0)
    out = np.empty_like(x)
    for flip, p, q in ((False, a, b), (True, b, a)):
        at = mirror == flip
        if at.any():
            z = 1.0 - x[at] if flip else x[at]
            value = _front(p, q, z) * _fraction(p, q, z)
            out[at] = 1.0 - value if flip else value
    return np.clip(out, 0.0, 1.0)


def _front(a: float, b: float, x: np.ndarray) -> np.ndarray:
    const = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - math.log(a)
    with np.errstate(divide="ignore"):
        return np.exp(const + a * np.log(x) + b * np.log1p(-x))


def _fraction(a: float, b: float, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 2000):
        for step in (m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))):
            term = step * x
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 3e-16):
            break
    return h


def t_two_sided(t: np.ndarray, df: float) -> np.ndarray:
    """Two-sided p-values of Student's t; NaN stays NaN."""
    t = np.asarray(t, float)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t)
    out[ok] = incomplete_beta(df / 2.0, 0.5, df / (df + t[ok] ** 2)) if df > 0 else np.nan
    out[np.isinf(t)] = 0.0
    return out


def log_choose(m: int, k: int) -> float:
    return math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
