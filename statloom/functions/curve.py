"""Percentile stretch: the Beta(1.3, 1.3) distribution function as a native expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import as_col

SHAPE = 1.3     # both Beta parameters
CEILING = 98.5  # percentiles at or above this reach 100
TERMS = 48


def series_coefficients(shape: float = SHAPE, terms: int = TERMS) -> list[float]:
    """c_n of I_x = x^a * sum(c_n x^n), from the binomial series of the density."""
    scale = math.gamma(2 * shape) / math.gamma(shape) ** 2
    out, rising = [], 1.0
    for n in range(terms):
        out.append(scale * rising / (shape + n))
        rising *= (1 - shape + n) / (n + 1)
    return out


def _bind(x: Column, body) -> Column:
    """body(x) with x worked out once: the lambda variable keeps a long formula small."""
    return F.transform(F.array(x), body)[0]


def _left_half(x: Column) -> Column:
    acc = F.lit(0.0)
    for c in reversed(series_coefficients()):
        acc = acc * x + F.lit(c)
    return F.pow(x, F.lit(SHAPE)) * acc


def beta_cdf(x) -> Column:
    """Distribution function on [0, 1]; the series runs on the half where it converges fast."""

    def value(v):
        part = _bind(F.least(v, F.lit(1.0) - v), _left_half)
        return F.when(v <= 0, 0.0).when(v >= 1, 1.0).when(v <= 0.5, part).otherwise(F.lit(1.0) - part)

    return _bind(as_col(x), value)


def stretch_percentile(p) -> Column:
    """0-100 percentile spread out over the scale; null stays null."""
    p = as_col(p)
    return F.when(p.isNotNull(), beta_cdf(F.least(p / CEILING, F.lit(1.0))) * 100)
