"""Statistics as column functions, and the few that need numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def half_even(value: Column, step: float = 1.0) -> Column:
    """Nearest multiple of step, ties to the even multiple."""
    return F.bround(value / F.lit(step), 0) * F.lit(step)


def down(value: Column, step: float = 0.5, slack: float = 1e-9) -> Column:
    """Largest multiple of step that isn't above value; a hair below a multiple counts as that multiple."""
    return F.floor(value / F.lit(step) + F.lit(slack)) * F.lit(step)


def binomial_two_sided(a: Column, b: Column) -> Column:
    """Exact p-value for a against b under equal chances: twice the smaller tail, 1 at most, 1 without trials.

    The tail is summed from logarithms of binomial coefficients, built up by their ratios; no gamma function is needed.
    """
    n, k = a + b, F.least(a, b)
    start = F.struct(F.lit(0.0).alias("log"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def step(state: Column, i: Column) -> Column:
        log = state["log"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(log.alias("log"), (state["sum"] + F.exp(log - n * F.log(F.lit(2.0)))).alias("sum"))

    tail = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1)).cast("bigint")), start, step, lambda s: s["sum"])).otherwise(F.exp(-n * F.log(F.lit(2.0))))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def gamma_cdf(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: a series below the shape, a continued fraction above."""
    shape, x = np.broadcast_arrays(np.asarray(shape, float), np.asarray(x, float))
    out = np.zeros(x.shape)
    for i, (a, t) in enumerate(zip(shape.ravel(), x.ravel(), strict=True)):
        if t <= 0:
            continue
        scale = math.exp(-t + a * math.log(t) - math.lgamma(a))
        if t < a + 1:
            term = total = 1 / a
            n = a
            while abs(term) > abs(total) * 1e-16:
                n += 1
                term *= t / n
                total += term
            out.ravel()[i] = total * scale
        else:
            b = t + 1 - a
            c, d = 1e300, 1 / b
            h = d
            for k in range(1, 10_000):
                step = -k * (k - a)
                b += 2
                d = 1 / (step * d + b or 1e-300)
                c = b + step / c or 1e-300
                h *= d * c
                if abs(d * c - 1) < 1e-16:
                    break
            out.ravel()[i] = 1 - scale * h
    return out


def gamma_quantile(p: float, shape: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma distributions, by bisection on the logarithm."""
    shape, rate = np.asarray(shape, float), np.asarray(rate, float)
    low = np.full(shape.shape, -700.0)
    high = np.log(np.maximum(shape, 1.0)) + 10.0
    for _ in range(200):
        middle = (low + high) / 2
        under = gamma_cdf(shape, np.exp(middle)) < p
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return np.exp(high) / rate


def gamma_interval(p: float):
    """pandas UDF (shape, rate) -> quantile. Distinct pairs are few: it should run on them, not on rows."""

    @F.pandas_udf(DoubleType())
    def quantile(shape: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series(gamma_quantile(p, shape.to_numpy(), rate.to_numpy()))

    return quantile
