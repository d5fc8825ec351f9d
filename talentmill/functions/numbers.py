"""Exact arithmetic helpers: sums that do not depend on partition order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(value: Column) -> Column:
    """Two-decimal amount, so that sums are exact."""
    return value.cast("decimal(18,2)")


def micros(value: Column) -> Column:
    """Value in millionths as an exact whole number."""
    return (value.cast("decimal(18,6)") * 1000000).cast("decimal(24,0)")


def rounded_ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """numerator / denominator rounded half up, by whole-number division.

    Both must be non-negative whole numbers; the result is a double. Rounding an
    already rounded decimal quotient would round twice.
    """
    scaled = numerator.cast("decimal(38,0)") * 10**digits
    halves = (scaled * 2 + denominator).cast("decimal(38,0)")
    whole = F.call_function("div", halves, (denominator * 2).cast("decimal(38,0)"))
    return whole.cast("double") / 10**digits
