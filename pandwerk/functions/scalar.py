"""Scalar column helpers whose exact semantics results depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(c: Column, scale: int = 0) -> Column:
    """Half-even rounding; ``round`` in Spark is half-up."""
    return F.rint(c) if scale == 0 else F.rint(c * F.lit(10.0**scale)) / F.lit(10.0**scale)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def pad_id(c: Column | str) -> Column:
    """16-character zero-padded text id."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lpad(c.cast("string"), 16, "0")


def linear_percentile(sorted_values: Column, p: float) -> Column:
    """Linear-interpolated percentile of an ascending array held in one row; NULL when empty."""
    n = F.size(sorted_values)
    pos = (n - 1) * F.lit(float(p))
    lo = F.floor(pos).cast("int")
    low = F.try_element_at(sorted_values, lo + 1)
    high = F.try_element_at(sorted_values, F.least(lo + 2, n))
    return F.when(n > 0, low + (high - low) * (pos - lo))
