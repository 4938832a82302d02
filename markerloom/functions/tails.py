"""Binomial tails as pandas UDFs (F8), and the chi-square tail as an expression.

These run on features x clusters rows only, never on samples.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms of the series and levels of the fraction below.
TERMS = 60

# Ship these helpers inside the UDF, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (Lentz form), for all rows at once."""
    tiny = 1e-300

    def apart(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) > tiny, v, tiny)

    out, open_ = np.ones(len(x)), np.arange(len(x))
    c, d = np.ones(len(x)), 1.0 / apart(1.0 - (a + b) * x / (a + 1.0))
    total = d
    for m in range(1, 200_000):
        if not len(open_):
            return out
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / apart(1.0 + numerator * d)
            c = apart(1.0 + numerator / c)
            step = d * c
            total = total * step
        left = np.abs(step - 1.0) >= 1e-14
        if not left.all():
            out[open_] = total
            a, b, x, c, d, total, open_ = (v[left] for v in (a, b, x, c, d, total, open_))
    raise ArithmeticError(f"{len(open_)} tails did not converge")


def _beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function for 0 < x < 1."""
    logs = _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
    front = np.exp(logs + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1.0) / (a + b + 2.0)
    one, two, share = np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1.0 - x)
    tail = front * _beta_fraction(one, two, share) / one
    return np.where(low, tail, 1.0 - tail)


def _arrays(k, draws, p) -> tuple[np.ndarray, ...]:
    return tuple(np.atleast_1d(a) for a in np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (k, draws, p))))


def at_most(k, draws, p) -> np.ndarray:
    """P(K <= k) for K ~ Binomial(draws, p), for arrays of each."""
    k, draws, p = _arrays(k, draws, p)
    out = np.where((k < 0) | ((k < draws) & (p >= 1.0)), 0.0, 1.0)
    open_ = (k >= 0) & (k < draws) & (p > 0.0) & (p < 1.0)
    out[open_] = _beta_share(draws[open_] - k[open_], k[open_] + 1.0, 1.0 - p[open_])
    return out


def at_least(k, draws, p) -> np.ndarray:
    """P(K >= k) for K ~ Binomial(draws, p), for arrays of each."""
    k, draws, p = _arrays(k, draws, p)
    out = np.where((k <= 0) | ((k <= draws) & (p >= 1.0)), 1.0, 0.0)
    open_ = (k > 0) & (k <= draws) & (p > 0.0) & (p < 1.0)
    out[open_] = _beta_share(k[open_], draws[open_] - k[open_] + 1.0, p[open_])
    return out


def _spread(k, draws, p) -> np.ndarray:
    k, draws, p = _arrays(k, draws, p)
    edge = np.minimum(k, draws - k)
    share = np.minimum(1.0, at_most(edge - 1, draws, p) + at_least(draws - edge + 1, draws, p))
    return np.where((p <= 0.0) | (p >= 1.0), 1.0, share)


def _two_sided(k, draws, p) -> np.ndarray:
    return np.minimum(1.0, 2.0 * np.minimum(at_most(k, draws, p), at_least(k, draws, p)))


def _rows(rule, k: pd.Series, draws: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(rule(k, draws, p), dtype="float64")


def chi_square_tail(value: Column) -> Column:
    """Chance of a chi-square of one degree of freedom above ``value``: the complementary error function of its half's root.

    A series of positive terms below 8, a continued fraction above; NULL stays NULL.
    """
    half = value / 2.0
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def longer(held: Column, n: Column) -> Column:
        term = held["term"] * half / (n + 0.5)
        return F.struct(term.alias("term"), (held["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, longer, lambda held: held["total"])
    near = 1.0 - F.exp(-half) * 2.0 * F.sqrt(half / math.pi) * series
    fraction = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), lambda below, n: 1.0 + n / value / below)
    far = F.exp(-half) / F.sqrt(half * math.pi) / fraction
    return F.when(value < 8.0, F.greatest(near, F.lit(0.0))).when(value >= 8.0, far)


@F.pandas_udf(T.DoubleType())
def binomial_spread_p(k: pd.Series, draws: pd.Series, p: pd.Series) -> pd.Series:
    """Chance that a background draw of this size varies less than the cluster.

    The variance of ``draws`` 0/1 values with k ones grows with k(draws-k), so
    the bootstrap share "variance below the cluster's" has this exact limit.
    """
    return _rows(_spread, k, draws, p)


@F.pandas_udf(T.DoubleType())
def binomial_two_sided_p(k: pd.Series, draws: pd.Series, p: pd.Series) -> pd.Series:
    """Two-sided tail of the cluster's count of ones against the background."""
    return _rows(_two_sided, k, draws, p)
