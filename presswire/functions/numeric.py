"""Numeric helpers with pinned rounding and division rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_half_away(value: Column, digits: int) -> Column:
    """Round a double half away from zero; NULL stays NULL, never returns -0.0."""
    scale = float(10**digits)
    steps = F.floor(F.abs(value) * F.lit(scale) + F.lit(0.5)).cast("double")
    return F.when(steps == 0.0, F.lit(0.0)).otherwise(F.signum(value) * steps / F.lit(scale))


def stable_round(value: Column, digits: int = 6) -> Column:
    """Round to `digits` after snapping away the noise of float summation order."""
    return round_half_away(round_half_away(value, 10), digits)


def percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    """`part` as a percentage of `whole`, NULL when `whole` is zero."""
    return round_half_away(
        F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double")), digits
    )


def to_double(text: Column) -> Column:
    """Plain decimal or scientific text as a double, anything else NULL."""
    trimmed = F.trim(text)
    numeric = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return F.when(trimmed.rlike(numeric), trimmed.try_cast("double"))
