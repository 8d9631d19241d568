"""Ratios that keep *undefined* (0/0, NULL) apart from *unbounded* (x/0, infinity)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def ratio(num: Column, den: Column) -> Column:
    """``num / den``; NULL when undefined (0/0), infinity when unbounded (x/0)."""
    return (
        F.when(den != 0, F.try_divide(num.cast("double"), den.cast("double")))
        .when((den == 0) & (num > 0), F.lit(INF))
        .when((den == 0) & (num < 0), F.lit(-INF))
    )


def rate(num: Column, den: Column) -> Column:
    """Share ``num / den`` of counts; NULL for an empty denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def no_nan(col: Column) -> Column:
    """NaN becomes NULL, so aggregates skip it and comparisons ignore it."""
    return F.when(~F.isnan(col), col)


def finite(col: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(~F.isnan(col) & (F.abs(col) != INF), col)


def is_finite(col: Column) -> Column:
    """True for finite numbers; false for NULL, NaN and infinities."""
    return F.coalesce(~F.isnan(col) & (F.abs(col) != INF), F.lit(False))
