"""Arithmetic whose corner cases differ between engines, composed from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide_no_nan(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


def floor_divide(a: Column, b: Column) -> Column:
    """Floored division of doubles for b > 0, exact at multiples: 1.0 by 0.1 is 9."""
    q = (a - a % b) / b - F.when(a % b < 0, 1.0).otherwise(0.0)
    return F.floor(q) + F.when(q - F.floor(q) > 0.5, 1.0).otherwise(0.0)


def safe_ln(x: Column) -> Column:
    """Natural logarithm; null where x isn't positive, so that aggregates skip what has none."""
    return F.when(x > 0, F.ln(x))


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b as IEEE 754 has it, in ANSI mode too: infinite where only b is 0, NaN where both are."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def ieee_ln(x: Column) -> Column:
    """Natural logarithm as IEEE 754 has it: -infinity at 0, NaN below."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def floor_divide_sql(a: str, b: str) -> str:
    """The same for SQL engines whose % on doubles is C's fmod."""
    q = f"((({a}) - ({a}) % ({b})) / ({b}) - CASE WHEN ({a}) % ({b}) < 0 THEN 1.0 ELSE 0.0 END)"
    return f"(floor({q}) + CASE WHEN {q} - floor({q}) > 0.5 THEN 1.0 ELSE 0.0 END)"
