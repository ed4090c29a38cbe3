"""Exact fixed-point helpers (Column -> Column, JVM-side).

Ratios of decimal values are rational numbers whose decimal expansion often
ends exactly on a rounding tie (an average of 20 prices lands on ``x.xx5`` one
time in 2,000).  Rounding the double ``S / n`` then depends on how the tie
happens to be represented in binary.  These helpers keep such arithmetic in
whole units and round with exact integer division, half away from zero
(Spark's HALF_UP rule), so the result does not depend on the engine or on
float representation.

Prices and rates are taken to twelve decimals, as whole 1e-12 units in a
DECIMAL(38,0): values below 1e14 fit, their sums and cross products too (larger
ones fail under ANSI).  A double stands for the shortest decimal that names it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 12
UNITS = 10 ** SCALE
WHOLE = "decimal(38,0)"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def to_units(c, scale: int = SCALE) -> Column:
    """A value with at most ``scale`` decimals as exact 10^-scale units, DECIMAL(38,0)."""
    power = F.lit(10 ** scale).cast(f"decimal({scale + 1},0)")
    return (_c(c).cast(f"decimal({14 + scale},{scale})") * power).cast(WHOLE)


def from_units(u: Column, scale: int = SCALE) -> Column:
    """Whole 10^-scale units back to double (one correctly rounded division)."""
    return u.cast("double") / F.lit(float(10 ** scale))


def _integral_divide(a: Column, b: Column) -> Column:
    # ``div`` through the SQL function registry keeps the expression compact;
    # it takes longs or decimals and returns a long.
    # A zero denominator becomes NULL first: under ANSI mode a shared ``div``
    # may be evaluated ahead of the guard that protects it.
    return F.call_function("div", a, F.when(b != 0, b))


_HALF = 31
_LOW_MASK = (1 << _HALF) - 1


def split_sum(c: Column) -> list[Column]:
    """Partial aggregates for ``exact_long_sum``: sums of the high and low 31 bits.

    For non-negative longs below 2^40 neither half can overflow before 2^23
    (high) / 2^32 (low) times more rows than any cluster holds, and both are
    plain long sums (fast, map-side combined).
    """
    return [F.sum(F.shiftright(c, _HALF)), F.sum(c.bitwiseAND(F.lit(_LOW_MASK)))]


def combine_split(hi: Column, lo: Column) -> Column:
    """Exact total from the two halves, as DECIMAL(38,0)."""
    d = "decimal(38,0)"
    return hi.cast(d) * F.lit(1 << _HALF).cast(d) + lo.cast(d)


def intdiv(a: Column, b: Column) -> Column:
    """a / b truncated toward zero, exact for longs; NULL when b = 0."""
    return F.when(b != 0, _integral_divide(a, b))


def round_div(a: Column, b: Column) -> Column:
    """a / b rounded half away from zero to a whole number, exact; NULL when b = 0."""
    num = F.abs(a) * 2 + F.abs(b)
    mag = _integral_divide(num, F.abs(b) * 2)  # a long
    return F.when(b != 0, F.when((a < 0) != (b < 0), -mag).otherwise(mag))


def ratio_round(num_units: Column, den_units: Column, scale: int) -> Column:
    """(num / den) rounded half-up to ``scale`` decimals, as double."""
    return from_units(round_div(num_units * (10 ** scale), den_units), scale)
