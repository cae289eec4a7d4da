"""Tails of averaged noise powers: the incomplete gamma function, what follows from it, and the trigamma function.

An averaged power of n independent looks is gamma distributed with shape n and, here, mean 1. Everything works on numpy
arrays; ``column`` makes a pandas UDF of a function of one or two numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
DEPTH = 400


def upper(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma function; 1 for x <= 0.

    Below a + 1 one minus a sum of positive terms; above it a continued fraction, worked out from its depth upwards, so
    that far tails keep their digits.
    """
    a, x = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(a, x))
    out, near = np.ones(a.shape), (x > 0) & (x < a + 1)
    far = x >= np.maximum(a + 1, 1e-300)
    if near.any():
        p, y = a[near], x[near]
        term = total = np.ones(p.shape)
        for k in range(1, int(p.max() + 60 * math.sqrt(p.max() + 1)) + 60):
            term = term * y / (p + k)
            total = total + term
        out[near] = 1 - total * np.exp(p * np.log(y) - y - _lgamma(p + 1))
    if far.any():
        p, y = a[far], x[far]
        rest = np.zeros(p.shape)
        for k in range(DEPTH, 0, -1):
            rest = k * (k - p) / (y + 2 * k + 1 - p - rest)
        out[far] = np.exp(p * np.log(y) - y - _lgamma(p)) / (y + 1 - p - rest)
    return np.where(np.isnan(a) | np.isnan(x), np.nan, out)


def upper_inverse(a, q) -> np.ndarray:
    """The x whose upper tail is q, by halving an interval of logarithms."""
    a, q = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(a, q))
    lo, hi = np.full(a.shape, -80.0), np.log(a + 40 * np.sqrt(a) + 800)
    for _ in range(90):
        mid = (lo + hi) / 2
        above = upper(a, np.exp(mid)) > q
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.exp((lo + hi) / 2)


def floor_threshold(n, false_alarm) -> np.ndarray:
    """How many times its mean an averaged power of n looks exceeds with a probability."""
    return upper_inverse(n, false_alarm) / n


def percentile_bias_db(n, p) -> np.ndarray:
    """What a percentile p (0 to 1) of averaged powers reads relative to their mean, in dB."""
    return 10 * np.log10(upper_inverse(n, 1 - np.asarray(p, float)) / n)


def chi_square_tail(x, k) -> np.ndarray:
    """Chance that a chi-square variable of k degrees of freedom reaches x; 0 where x isn't finite or k is 0."""
    x, k = np.broadcast_arrays(np.asarray(x, float), np.asarray(k, float))
    good = np.isfinite(x) & (k > 0)
    return np.where(good, upper(np.where(k > 0, k, 1) / 2, np.where(good, x, 0) / 2).reshape(x.shape), 0.0)


def ordered_factor(n: float, cells: int, rank: int, false_alarm: float) -> float:
    """The factor on the ``rank``-th smallest of ``cells`` gamma cells of n looks that noise exceeds with a probability."""
    x = np.exp(np.linspace(-30, math.log(40 + 20 / math.sqrt(n)), 6000))
    tail = upper(n, n * x)
    density = np.exp(n * math.log(n) + (n - 1) * np.log(x) - n * x - math.lgamma(n))
    below = np.clip(1 - tail, 1e-300, 1)
    log_count = math.lgamma(cells + 1) - math.lgamma(rank) - math.lgamma(cells - rank + 1)
    ranked = np.exp(log_count + (rank - 1) * np.log(below) + (cells - rank) * np.log(np.maximum(tail, 1e-300))) * density
    lo, hi = -5.0, 15.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.trapezoid(ranked * upper(n, n * x * math.exp(mid)), x) > false_alarm else (lo, mid)
    return math.exp((lo + hi) / 2)


def effective_averages(averages: int, taper: np.ndarray, hop: int) -> float:
    """Independent looks among overlapping tapered frames, from the correlation of their powers."""
    energy, k, n = float((taper**2).sum()), averages, len(taper)
    shared = sum((1 - j / k) * (float((taper[: n - j * hop] * taper[j * hop :]).sum()) / energy) ** 2 for j in range(1, k) if j * hop < n)
    return k / (1 + 2 * shared)


def trigamma(x) -> np.ndarray:
    """The second derivative of the logarithm of the gamma function, for x > 0: ten steps up, then its expansion."""
    x = np.asarray(x, float)
    steps = sum(1 / (x + i) ** 2 for i in range(10))
    y = 1 / (x + 10)
    return steps + y + y**2 / 2 + y**3 / 6 - y**5 / 30 + y**7 / 42 - y**9 / 30


#: Variance of a power's decibels per unit of the trigamma function.
DB_VARIANCE = (10 / math.log(10)) ** 2


def shape_of_db_variance(variance) -> np.ndarray:
    """The number of looks whose decibels vary so much, from 0.01 to 1e6."""
    v = np.asarray(variance, float) / DB_VARIANCE
    lo, hi = np.full(v.shape, math.log(0.01)), np.full(v.shape, math.log(1e6))
    for _ in range(80):
        mid = (lo + hi) / 2
        more = trigamma(np.exp(mid)) > v
        lo, hi = np.where(more, mid, lo), np.where(more, hi, mid)
    return np.where(np.isfinite(v) & (v > 0), np.exp((lo + hi) / 2), 1e6)


def column(of: Callable, *args: Column) -> Column:
    """A function of this module over columns; nulls give null."""

    @F.pandas_udf("double")
    def one(x: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(of(x.to_numpy(float)), float).reshape(len(x))).where(x.notna())

    @F.pandas_udf("double")
    def two(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(of(x.to_numpy(float), y.to_numpy(float)), float).reshape(len(x))).where(x.notna() & y.notna())

    return (one if len(args) == 1 else two)(*args)
