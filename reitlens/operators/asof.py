"""Backward as-of lookup: for each date, the latest observation on or before it.

Spark has no as-of join in its public API, and the textbook scalar subquery
(``… WHERE obs.date <= p.date ORDER BY obs.date DESC LIMIT 1``) plans as a
nested-loop join, quadratic in dates × observations.  Here the lookup is
linear:

1. reduce the left side to its distinct dates (bounded by the calendar),
2. union those dates with the observations of each series,
3. carry the last non-null value forward with ``last(value, ignorenulls)``
   over ``partitionBy(series).orderBy(date, observations-first)``,
4. keep the date rows and pivot one column per series.

The result has one row per distinct date; joining it back to the left side is
an equi-join on ``date``.  Observations on the same date as a left row count
(``<=``); a date before the first observation gets NULL.  Several
observations on one date keep the largest value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_values(dates: DataFrame, obs: DataFrame, series: Sequence[str],
                names: Sequence[str] | None = None) -> DataFrame:
    """One row per distinct ``date`` of ``dates`` with one as-of column per series."""
    names = list(names or series)
    d = dates.select("date").distinct()
    o = (obs.where(F.col("series_id").isin(*series) & F.col("value").isNotNull())
         .groupBy("series_id", "date").agg(F.max("value").alias("value"))
         .withColumn("_left", F.lit(0)))
    sid = F.explode(F.array(*[F.lit(s) for s in series])).alias("series_id")
    left = d.select(sid, "date", F.lit(None).cast("double").alias("value"),
                    F.lit(1).alias("_left"))
    u = o.unionByName(left)
    w = (Window.partitionBy("series_id").orderBy("date", "_left")
         .rowsBetween(Window.unboundedPreceding, 0))
    filled = (u.withColumn("asof", F.last("value", ignorenulls=True).over(w))
              .where(F.col("_left") == 1))
    cols = [F.max(F.when(F.col("series_id") == s, F.col("asof"))).alias(n)
            for s, n in zip(series, names)]
    return filled.groupBy("date").agg(*cols)


RATE_SERIES = ("FEDFUNDS", "DGS10", "DGS2")
RATE_NAMES = ("fed_funds_rate", "treasury_10y", "treasury_2y")


def asof_rates(prices: DataFrame, indicators: DataFrame) -> DataFrame:
    """Fed funds, 10-year and 2-year rates in force on each price date."""
    return asof_values(prices, indicators, RATE_SERIES, RATE_NAMES)


def asof_join(left: DataFrame, obs: DataFrame, series: Sequence[str],
              names: Sequence[str] | None = None) -> DataFrame:
    """``left`` with the as-of value columns attached (left join on ``date``)."""
    return left.join(asof_values(left, obs, series, names), "date", "left")
