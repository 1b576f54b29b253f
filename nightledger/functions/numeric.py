"""Numeric column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def dbl(value: Column | float) -> Column:
    """A DOUBLE column, from a column or a plain number."""
    return (value if isinstance(value, Column) else F.lit(float(value))).cast("double")


def clip(value: Column, low: float, high: float) -> Column:
    """Restrict to ``[low, high]``; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as DOUBLE, null where the denominator is zero or null."""
    return dbl(top) / F.nullif(dbl(bottom), F.lit(0.0))


def finite(value: Column) -> Column:
    """True for a real number: not null, not NaN, not infinite.

    Spark sorts NaN above every number, so this has to be asked before any comparison.
    """
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(INF))


def finite_or(value: Column, fallback: Column | float) -> Column:
    fallback = fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    return F.when(finite(value), value).otherwise(fallback)


def truthy(value: Column) -> Column:
    """Null and zero both switch an optional limit off."""
    return value.isNotNull() & (value != F.lit(0.0))


def flag(condition: Column) -> Column:
    """A condition as 1.0 / 0.0; an unknown condition counts as 0.0."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def share(condition: Column) -> Column:
    """Share of rows for which a condition holds."""
    return F.avg(flag(condition))


def settled(frame: DataFrame, **digits: int) -> DataFrame:
    """Round report columns so that a result does not depend on summation order.

    Floating sums differ in their last bits with the order partitions arrive in; a
    published report should not.
    """
    return frame.withColumns({name: F.round(F.col(name), n) for name, n in digits.items()})
