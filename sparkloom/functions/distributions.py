"""Tail probabilities that Spark SQL lacks, as Arrow-batched functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _normal_sf(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(x / math.sqrt(2.0)) if x == x else math.nan for x in z])


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + step * d or tiny)
        c = 1.0 + step / c or tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    return front * (f - 1.0)


def t_two_sided_p(t: float, dof: float) -> float:
    """The probability of a t at least as far from 0."""
    return math.nan if t != t or not dof > 0 else incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


@F.pandas_udf(T.DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    return pd.Series(_normal_sf(z.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(a, b) for a, b in zip(t.to_numpy(float), dof.to_numpy(float), strict=True)]).replace({np.nan: None}).astype(float)


def rank_sum_tail(u: float, n1: int, n2: int) -> float:
    """The exact two-sided p of a rank sum without equal values, from the counts of all arrangements by their U."""
    small, large = sorted((int(n1), int(n2)))
    counts = np.zeros(small * large + 1)
    counts[0] = 1.0
    for i in range(1, small + 1):  # times (1 - q ** (large + i)) / (1 - q ** i)
        counts[large + i :] -= counts[: len(counts) - large - i].copy()
        for start in range(min(i, len(counts))):
            np.cumsum(counts[start::i], out=counts[start::i])
    far = max(u, small * large - u)
    return float(min(1.0, 2 * counts[math.ceil(far - 1e-9) :].sum() / counts.sum()))


@F.pandas_udf(T.DoubleType())
def rank_sum_p(u: pd.Series, n1: pd.Series, n2: pd.Series, z: pd.Series, ties: pd.Series) -> pd.Series:
    """p of a rank sum: exact with at most 8 values on a side and no equal ones, else by z; 1 where all are equal."""
    out = np.minimum(1.0, 2 * _normal_sf(z.to_numpy(float)))
    exact = (np.minimum(n1, n2) <= 8).to_numpy() & ~ties.to_numpy(bool)
    for i in np.flatnonzero(exact):
        out[i] = rank_sum_tail(u[i], n1[i], n2[i])
    return pd.Series(np.where(np.isnan(out), 1.0, out))
