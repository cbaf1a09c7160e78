"""Small numeric column helpers."""

from pyspark.sql import functions as F


def dp(col, places):
    """Round half-up to ``places`` decimals. The inner round removes binary noise first, so a decimal tie
    rounds the same way whatever the order of the additions that produced it."""
    return F.round(F.round(col, 9), places)


def clean(col):
    """NaN becomes null, the only missing value inside our tables."""
    return F.when(~F.isnan(col), col)


def falsy_default(col, default):
    """Zero and null both count as "not given"."""
    default = default if hasattr(default, "alias") else F.lit(default)
    return F.coalesce(F.nullif(col, F.lit(0.0)), default)


def clamp(col, low, high):
    return F.least(F.lit(high), F.greatest(F.lit(low), col))


def fixed(col, places):
    """Text with a fixed number of decimals."""
    return F.format_string(f"%.{places}f", dp(col, places))
