"""Macro series: indicator rows, latest values, spreads, trend and rate environment.

Observations are small per series (one row per series and date), so the
per-series window below is bounded by the calendar, not by data volume.  The
rate environment is a single global aggregate (partial aggregation per task,
one row out).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reitlens import constants as K
from reitlens.functions import scalars as S
from reitlens.functions.exact import UNITS, from_units, to_units

TREND_BAND_UNITS = UNITS // 10  # 0.1


def market_indicators(values: DataFrame, series_dim: DataFrame, source: str = "FRED") -> DataFrame:
    """(series_id, date, value) -> indicator rows with id and series metadata."""
    j = values.join(F.broadcast(series_dim.select("series_id", "name", "unit", "frequency")),
                    "series_id", "left")
    return j.select(
        S.indicator_id("series_id", "date").alias("indicator_id"),
        "series_id",
        F.coalesce("name", "series_id").alias("name"),
        "date", "value",
        F.coalesce("unit", F.lit("")).alias("unit"),
        F.coalesce("frequency", F.lit("")).alias("frequency"),
        F.lit(source).alias("source"),
    )


def _numbered(ind: DataFrame) -> DataFrame:
    """Valid observations numbered newest first per series (``rn``).

    Several rows on one date keep the largest value first.
    """
    w = Window.partitionBy("series_id").orderBy(F.col("date").desc(), F.col("value").desc())
    return (ind.where(F.col("value").isNotNull()).select("series_id", "date", "value")
            .withColumn("rn", F.row_number().over(w)))


def latest_indicator(ind: DataFrame) -> DataFrame:
    """Newest valid value per series (filtering first, then taking the newest)."""
    top = F.max_by(F.struct("date", "value"), F.struct("date", "value"))
    return (ind.where(F.col("value").isNotNull())
            .groupBy("series_id").agg(top.alias("t"))
            .select("series_id", F.col("t.date").alias("date"), F.col("t.value").alias("value")))


def topn_series(ind: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` valid observations of every series."""
    return _numbered(ind).where(F.col("rn") <= n)


def relevant_series(ind: DataFrame, end_date: dt.date, lookback_months: int = 24,
                    limit: int = 50) -> DataFrame:
    """The ten REIT-relevant series over ``months*30`` days up to ``end_date``, ≤ ``limit`` each."""
    start = end_date - dt.timedelta(days=lookback_months * 30)
    f = ind.where(F.col("series_id").isin(*K.RELEVANT_SERIES)
                  & F.col("date").between(F.lit(start), F.lit(end_date)))
    return _numbered(f).where(F.col("rn") <= limit).drop("rn")


def _latest_of(numbered: DataFrame, sid: str) -> Column:
    return F.max(F.when((F.col("series_id") == sid) & (F.col("rn") == 1), F.col("value")))


def series_spread(ind: DataFrame, a: str, b: str) -> DataFrame:
    """latest(a) - latest(b), exact; NULL if either is missing. One row."""
    nb = _numbered(ind).where(F.col("series_id").isin(a, b))
    va, vb = _latest_of(nb, a), _latest_of(nb, b)
    return nb.agg(from_units(to_units(va) - to_units(vb)).alias("spread"))


def _trend(numbered: DataFrame, sid: str) -> Column:
    """Mean of rows 1–3 vs rows 4–6 (both divided by 3), ±0.1 bands; needs ≥ 3 rows."""
    is_s = F.col("series_id") == sid
    u = to_units("value")
    n = F.sum(F.when(is_s & (F.col("rn") <= 6), 1).otherwise(0))
    recent = F.sum(F.when(is_s & (F.col("rn") <= 3), u).otherwise(0))
    older = F.sum(F.when(is_s & F.col("rn").between(4, 6), u).otherwise(0))
    # recent/3 > older/3 + 0.1  <=>  recent > older + 0.3 (in whole units)
    band = 3 * TREND_BAND_UNITS
    return (F.when(n < 3, "Stable").when(recent > older + band, "Rising")
            .when(recent < older - band, "Falling").otherwise("Stable"))


def rate_trend(ind: DataFrame, series_id: str = "FEDFUNDS") -> DataFrame:
    nb = _numbered(ind).where(F.col("series_id") == series_id)
    return nb.agg(_trend(nb, series_id).alias("rate_trend"))


def rate_environment(ind: DataFrame) -> DataFrame:
    """One-row macro snapshot with rate, curve and trend labels."""
    nb = _numbered(ind).where(F.col("rn") <= 6)
    fed, mort = _latest_of(nb, "FEDFUNDS"), _latest_of(nb, "WFII")
    t10, t2 = _latest_of(nb, "DGS10"), _latest_of(nb, "DGS2")
    snap = nb.agg(
        fed.alias("fed_funds_rate"), mort.alias("mortgage_30y"), t10.alias("treasury_10y"),
        t2.alias("treasury_2y"),
        from_units(to_units(t10) - to_units(t2)).alias("spread_10_2"),
        _latest_of(nb, "CPIAUCSL").alias("cpi_index"),
        _latest_of(nb, "UNRATE").alias("unemployment_rate"),
        _trend(nb, "FEDFUNDS").alias("rate_trend"),
    )
    f, m, sp = F.col("fed_funds_rate"), F.col("mortgage_30y"), F.col("spread_10_2")
    both = f.isNotNull() & (f != 0) & m.isNotNull() & (m != 0)
    fm = to_units(m) - to_units(f)
    rate = (F.when(both & (fm > 3 * UNITS), "Accommodative")
            .when(both & (fm < 3 * UNITS // 2), "Restrictive").otherwise("Neutral"))
    curve = (F.when(sp.isNull(), "Normal").when(sp < 0, "Inverted").when(sp < 0.5, "Flat")
             .when(sp > 2.0, "Steep").otherwise("Normal"))
    return snap.select(
        "fed_funds_rate", "mortgage_30y", "treasury_10y", "treasury_2y", "spread_10_2",
        "cpi_index", "unemployment_rate", rate.alias("rate_assessment"),
        curve.alias("curve_assessment"), "rate_trend")
