"""Rounding, ratios, clipping and missing-value rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import as_col


def round_half_even(c, digits: int = 0) -> Column:
    """numpy-style rounding: scale, round to even, scale back."""
    k = float(10**digits)
    return F.rint(as_col(c) * F.lit(k)) / F.lit(k)


def round_half_up(c, digits: int = 0) -> Column:
    """JavaScript-style rounding: halves go toward plus infinity.

    What lies within a millionth of a unit in the last place of a half counts as the half, so the order of additions does not show.
    """
    k = float(10**digits)
    return F.floor(F.rint(as_col(c) * F.lit(k) * F.lit(1e6)) / F.lit(1e6) + F.lit(0.5)) / F.lit(k)


def safe_ratio(numerator, denominator) -> Column:
    """numerator / denominator, null unless the denominator is positive."""
    d = as_col(denominator)
    return F.when(d > 0, as_col(numerator) / d)


def safe_percent(numerator, denominator) -> Column:
    return safe_ratio(numerator, denominator) * 100


def clip(c, low=None, high=None) -> Column:
    """Clamp to [low, high]; null stays null (least/greatest would skip it)."""
    c = as_col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low) if not isinstance(low, Column) else low)
    if high is not None:
        out = F.least(out, F.lit(high) if not isinstance(high, Column) else high)
    return F.when(c.isNotNull(), out)


def nan_to_null(c) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def zero_to_null(c) -> Column:
    """For sources where zero means 'not measured'."""
    c = as_col(c)
    return F.when(c != 0, c)


def blank_to_null(c) -> Column:
    c = as_col(c)
    return F.when(F.trim(c) != "", c)


def to_number(c, kind: str = "double") -> Column:
    """Numeric coercion: text that is no number becomes null, as does NaN."""
    out = as_col(c).cast("string").try_cast(kind)
    return nan_to_null(out) if kind == "double" else out


def parse_positive(c, digits: int = 3) -> Column:
    """Number from text that may carry quotes, an apostrophe or blanks; only positive values count."""
    v = F.regexp_replace(as_col(c).cast("string"), "[\"'\\s]", "").try_cast("double")
    return F.when(v > 0, round_half_even(v, digits))


def percent_repair(value) -> Column:
    """A share above 1 was stored as a percentage: bring it back to a share."""
    v = as_col(value)
    return F.when(v > 1, v / 100).otherwise(v)


def in_open_range(c, low: float, high: float) -> Column:
    """The value when it lies strictly between the bounds, else null."""
    c = as_col(c)
    return F.when((c > low) & (c < high), c)


def inches_to_feet(c) -> Column:
    return as_col(c) / 12


def per_hundred(c, digits: int = 3) -> Column:
    """Mean per-pitch value on a per-100 scale."""
    return round_half_even(as_col(c) * 100, digits)


def all_present(cols) -> Column:
    return reduce(lambda a, b: a & b, [as_col(c).isNotNull() for c in cols])


def display(value, decimals: int, scale: float = 1.0, missing: str = "—") -> Column:
    """Fixed-decimal text of value * scale, or a dash when missing."""
    v = nan_to_null(as_col(value).cast("double")) * F.lit(float(scale))
    return F.when(v.isNull(), F.lit(missing)).otherwise(F.format_string(f"%.{decimals}f", v))


def weighted_mean_present(values, weights) -> Column:
    """Mean of the non-null values of one row; their weights are renormalised."""
    pairs = [(as_col(v), as_col(w)) for v, w in zip(values, weights)]
    top = reduce(lambda a, b: a + b, [F.coalesce(v * w, F.lit(0.0)) for v, w in pairs])
    bottom = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), w).otherwise(0.0) for v, w in pairs])
    return F.when(bottom > 0, top / bottom)
