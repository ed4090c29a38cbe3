"""Order-independent aggregates.

A double ``sum``/``avg`` depends on the order in which partial sums meet, so the
same query can differ in the last bits between runs with different
partitioning.  Values are taken to ``SUM_SCALE`` decimals, far beyond those of
prices and ratios (a value of 1e16 or more fails under ANSI), so they are summed
exactly as DECIMAL and divided once in double precision: the
result is the same whatever the partitioning or the executor count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 4
SUM_SCALE = 12


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def exact_sum(c, scale: int = SUM_SCALE) -> Column:
    """Exact sum of a double column with at most ``scale`` decimals, as double."""
    return F.sum(_c(c).cast(f"decimal(28,{scale})")).cast("double")


def exact_avg(c, scale: int = SUM_SCALE) -> Column:
    """``avg`` from an exact decimal sum; NULLs ignored, NULL for no rows."""
    col = _c(c)
    n = F.count(col)
    return F.when(n > 0, F.try_divide(exact_sum(col, scale), n))


def round4(c: Column) -> Column:
    return F.round(c, SCALE)
