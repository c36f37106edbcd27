"""Losses of count models as columns, Arrow-batched where Spark lacks the function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-10


@F.pandas_udf(T.DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    """The logarithm of the gamma function; equal values are worked out once."""
    values, at = np.unique(x.to_numpy(float), return_inverse=True)
    return pd.Series(np.array([math.lgamma(v) if v == v and v > 0 else math.nan for v in values])[at])


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def nb_log_likelihood(x: Column, mean: Column, disp: Column, eps: float = EPS) -> Column:
    """MOD1: the logarithm of the negative binomial probability of a count, by its mean and inverse dispersion."""
    whole = F.log(disp + mean + eps)
    return lgamma(x + disp) - lgamma(x + 1.0) - lgamma(disp) + disp * (F.log(disp + eps) - whole) + x * (F.log(mean + eps) - whole)


def zinb_log_likelihood(x: Column, mean: Column, disp: Column, pi: Column, eps: float = EPS) -> Column:
    """MOD1: the same with extra zeros, pi being their logit; a count below 1e-8 is a zero."""
    whole, rest = F.log(disp + mean + eps), softplus(-pi)
    zero = disp * (F.log(disp + eps) - whole) - rest
    zero_case = -softplus(-zero + F.log(F.exp(rest) - 1 + eps))
    return F.when(x < 1e-8, zero_case).otherwise(nb_log_likelihood(x, mean, disp, eps) - rest)
