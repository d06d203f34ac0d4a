"""Exact integer arithmetic for ratios of counters."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def guarded(divisor: Column) -> Column:
    """The divisor, or NULL when it is zero (a zero divisor raises in ANSI mode)."""
    return F.nullif(divisor, F.lit(0))


def half_up(num: Column, den: Column | int, scale: int, precision: int = 18) -> Column:
    """``num / den`` as ``decimal(precision, scale)``, rounded half away from zero.

    Works on whole numbers only, so no digit is lost before the rounding.  Whole part and remainder are
    scaled apart, which keeps every intermediate inside 64 bits for counters up to about 10**16.
    A NULL or zero ``den`` gives NULL.
    """
    num = num.cast("bigint")
    den = (den if isinstance(den, Column) else F.lit(den)).cast("bigint")
    n, d = F.abs(num), guarded(F.abs(den))
    unit = 10**scale
    whole = div(n, d) * unit + div((n % d) * (2 * unit) + d, d * 2)
    signed = F.when((num < 0) != (den < 0), -whole).otherwise(whole)
    step = F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({scale + 1},{scale})")
    return (signed.cast("decimal(20,0)") * step).cast(f"decimal({precision},{scale})")


def trimmed_mean(total: Column, low: Column, high: Column, n: Column, scale: int = 1) -> Column:
    """Mean without the two extremes, in whole numbers: unit conversion first, then the mean."""
    rest = total - high - low
    return div(div(rest, scale) if scale != 1 else rest, guarded(n - 2))
