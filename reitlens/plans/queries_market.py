"""Registered price and macro queries with their DuckDB oracles."""

from __future__ import annotations

import datetime as dt

from reitlens import constants as K
from reitlens.operators import asof as AS
from reitlens.operators import macro as MA
from reitlens.operators import prices as PR
from reitlens.plans.oracle import (measure_at, register, rdiv, rratio, units,
                                   with_tables)
from reitlens.plans.registry import query
from reitlens.sources import bind, dims
from reitlens.sources.tables import Lake, lake_for

PERIODS = tuple(p for p, _ in K.RETURN_PERIODS)


def indicators(spark, lake: Lake):
    return MA.market_indicators(bind.market_indicator_values(lake), dims.series(spark))


# ---------------------------------------------------------------------------
# per-ticker price metrics (SQL)
# ---------------------------------------------------------------------------

def _per_sql(hist: str = "hist") -> str:
    cols = ["ticker", "count(*) AS n",
            "max(CASE WHEN rn = 1 THEN close END) AS price",
            "max(CASE WHEN rn = 1 THEN date END) AS date",
            "max(CASE WHEN rn = 1 THEN volume END) AS volume",
            "max(CASE WHEN rn = 1 THEN cu END) AS cur"]
    cols += [f"max(CASE WHEN rn = {p + 1} THEN cu END) AS past_{p}" for p in PERIODS]
    cols += [f"sum(CASE WHEN rn <= {w} THEN cu END) AS sum_{w}" for w in K.MA_WINDOWS]
    return f"SELECT {', '.join(cols)} FROM {hist} GROUP BY ticker"


def _ret_sql() -> list[str]:
    return [f"CASE WHEN n >= 2 AND n > {p} THEN {rratio(f'(cur - past_{p}) * 100', f'past_{p}', 2)} END "
            f"AS {PR.return_label(p)}" for p in PERIODS]


def _ma_sql() -> list[str]:
    out = []
    for w in K.MA_WINDOWS:
        out.append(f"CASE WHEN n >= {w} THEN {measure_at(rdiv(f'sum_{w}', str(w * 100)), 2)} END AS ma_{w}")
        out.append(f"CASE WHEN n >= {w} THEN {rratio(f'(cur * {w} - sum_{w}) * 100', f'sum_{w}', 2)} END "
                   f"AS pct_from_ma_{w}")
    return out


def _vol_sql(hist: str = "hist", window: int = K.VOLATILITY_WINDOW) -> str:
    return f"""SELECT ticker, stddev_pop(r) AS sd FROM (
      SELECT ticker, rn, (close - lead(close) OVER (PARTITION BY ticker ORDER BY date DESC))
                         / lead(close) OVER (PARTITION BY ticker ORDER BY date DESC) AS r
      FROM {hist}) WHERE rn <= {window} GROUP BY ticker"""


VOL_COLS = (f"CASE WHEN n >= {K.VOLATILITY_WINDOW + 1} THEN round(sd * 100.0, 4) ELSE 0.0 END AS volatility_daily, "
            f"CASE WHEN n >= {K.VOLATILITY_WINDOW + 1} THEN round(sd * sqrt(252.0) * 100.0, 2) ELSE 0.0 END "
            f"AS volatility_annual")

register("hist100f", """
hist100f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM price_data) WHERE rn <= 100)""", ("price_data",))
register("hist100", "\nhist100 AS (SELECT * FROM hist WHERE rn <= 100)", ("hist",))


@query("period_returns", oracle=with_tables(
    f"SELECT ticker, {', '.join(_ret_sql())} FROM ({_per_sql()})", "hist"))
def q_period_returns(spark, sf_dir):
    return PR.period_returns(bind.price_data(lake_for(spark, sf_dir)))


@query("moving_averages", oracle=with_tables(
    f"SELECT ticker, {', '.join(_ma_sql())} FROM ({_per_sql()})", "hist"))
def q_moving_averages(spark, sf_dir):
    return PR.moving_averages(bind.price_data(lake_for(spark, sf_dir)))


@query("volatility", oracle=with_tables(
    f"SELECT p.ticker, {VOL_COLS} FROM ({_per_sql()}) p LEFT JOIN ({_vol_sql()}) v ON p.ticker = v.ticker",
    "hist"))
def q_volatility(spark, sf_dir):
    return PR.volatility(bind.price_data(lake_for(spark, sf_dir)))


def _summary_sql(hist: str) -> str:
    return (f"SELECT p.ticker, price, date, volume, {', '.join(_ret_sql())}, {', '.join(_ma_sql())}, "
            f"{VOL_COLS} FROM ({_per_sql(hist)}) p LEFT JOIN ({_vol_sql(hist)}) v ON p.ticker = v.ticker")


@query("price_summary", headline=True, oracle=with_tables(_summary_sql("hist"), "hist"))
def q_price_summary(spark, sf_dir):
    return PR.price_metrics(bind.price_data(lake_for(spark, sf_dir)))


@query("price_summary_compact", oracle=with_tables(_summary_sql("hist100"), "hist100"))
def q_price_summary_compact(spark, sf_dir):
    return PR.price_metrics(bind.price_data(lake_for(spark, sf_dir)),
                            history_rows=K.COMPACT_HISTORY_ROWS)


ETFS = tuple(s for s, _ in K.REIT_ETFS)
register("etf_hist", f"""
etf_hist AS (
  SELECT *, {units('close')} AS cu, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn
  FROM (SELECT [{', '.join(repr(s) for s in (*ETFS, bind.UNKNOWN_ETF))}][CAST(substr(ticker, 2) AS BIGINT) % {len(ETFS) + 1} + 1] AS ticker, date,
               {measure_at(f"CAST(sum({units('close')}) AS BIGINT) // count(*)", 4)} AS close, CAST(sum(volume) AS BIGINT) AS volume
        FROM price_data GROUP BY ALL)
)""", ("price_data",))


@query("etf_summary", oracle=with_tables(
    f"SELECT *, ticker <> '{bind.UNKNOWN_ETF}' AS known_etf FROM ({_summary_sql('etf_hist')})", "etf_hist"))
def q_etf_summary(spark, sf_dir):
    return PR.etf_summary(bind.etf_prices(lake_for(spark, sf_dir), ETFS), dims.etfs(spark))


# ---------------------------------------------------------------------------
# macro
# ---------------------------------------------------------------------------

@query("market_indicators", oracle=with_tables("SELECT * FROM market_indicators", "market_indicators"))
def q_market_indicators(spark, sf_dir):
    return indicators(spark, lake_for(spark, sf_dir))


@query("latest_indicator", oracle=with_tables(
    "SELECT series_id, date, value FROM numbered WHERE rn = 1", "numbered"))
def q_latest_indicator(spark, sf_dir):
    return MA.latest_indicator(indicators(spark, lake_for(spark, sf_dir)))


@query("topn_series", oracle=with_tables(
    "SELECT series_id, date, value, CAST(rn AS INTEGER) AS rn FROM numbered WHERE rn <= 6", "numbered"))
def q_topn_series(spark, sf_dir):
    return MA.topn_series(indicators(spark, lake_for(spark, sf_dir)), 6)


RELEVANT_END = dt.date(2001, 12, 31)


@query("relevant_series", oracle=with_tables(f"""
SELECT series_id, date, value FROM (
  SELECT series_id, date, value,
         row_number() OVER (PARTITION BY series_id ORDER BY date DESC, value DESC) AS rn
  FROM indicator_values
  WHERE value IS NOT NULL
    AND series_id IN ({', '.join(repr(s) for s in K.RELEVANT_SERIES)})
    AND date BETWEEN DATE '{RELEVANT_END}' - INTERVAL {24 * 30} DAY AND DATE '{RELEVANT_END}')
WHERE rn <= 50""", "indicator_values"))
def q_relevant_series(spark, sf_dir):
    return MA.relevant_series(indicators(spark, lake_for(spark, sf_dir)), RELEVANT_END, 24, 50)


def _latest_sql(sid: str) -> str:
    return f"max(CASE WHEN series_id = '{sid}' AND rn = 1 THEN value END)"


SPREAD_SQL = (f"CAST({units(_latest_sql('DGS10'))} - {units(_latest_sql('DGS2'))} AS DOUBLE) "
              f"/ CAST(10000 AS DOUBLE)")


@query("series_spread", oracle=with_tables(
    f"SELECT {SPREAD_SQL} AS spread FROM numbered WHERE series_id IN ('DGS10', 'DGS2')", "numbered"))
def q_series_spread(spark, sf_dir):
    return MA.series_spread(indicators(spark, lake_for(spark, sf_dir)), "DGS10", "DGS2")


def _trend_sql(sid: str = "FEDFUNDS") -> str:
    u = units("value")
    n = f"sum(CASE WHEN series_id = '{sid}' AND rn <= 6 THEN 1 ELSE 0 END)"
    rec = f"sum(CASE WHEN series_id = '{sid}' AND rn <= 3 THEN {u} ELSE 0 END)"
    old = f"sum(CASE WHEN series_id = '{sid}' AND rn BETWEEN 4 AND 6 THEN {u} ELSE 0 END)"
    return (f"CASE WHEN {n} < 3 THEN 'Stable' WHEN {rec} > {old} + 3000 THEN 'Rising' "
            f"WHEN {rec} < {old} - 3000 THEN 'Falling' ELSE 'Stable' END")


@query("rate_trend", oracle=with_tables(
    f"SELECT {_trend_sql()} AS rate_trend FROM numbered WHERE series_id = 'FEDFUNDS'", "numbered"))
def q_rate_trend(spark, sf_dir):
    return MA.rate_trend(indicators(spark, lake_for(spark, sf_dir)))


RATE_ENV_SQL = f"""
SELECT fed_funds_rate, mortgage_30y, treasury_10y, treasury_2y, spread_10_2, cpi_index,
       unemployment_rate,
       CASE WHEN both_ok AND fm > 30000 THEN 'Accommodative'
            WHEN both_ok AND fm < 15000 THEN 'Restrictive' ELSE 'Neutral' END AS rate_assessment,
       CASE WHEN spread_10_2 IS NULL THEN 'Normal' WHEN spread_10_2 < 0 THEN 'Inverted'
            WHEN spread_10_2 < 0.5 THEN 'Flat' WHEN spread_10_2 > 2.0 THEN 'Steep'
            ELSE 'Normal' END AS curve_assessment,
       rate_trend
FROM (
  SELECT *, coalesce(fed_funds_rate IS NOT NULL AND fed_funds_rate <> 0
                     AND mortgage_30y IS NOT NULL AND mortgage_30y <> 0, false) AS both_ok,
         {units('mortgage_30y')} - {units('fed_funds_rate')} AS fm
  FROM (
    SELECT {_latest_sql('FEDFUNDS')} AS fed_funds_rate, {_latest_sql('WFII')} AS mortgage_30y,
           {_latest_sql('DGS10')} AS treasury_10y, {_latest_sql('DGS2')} AS treasury_2y,
           {SPREAD_SQL} AS spread_10_2,
           {_latest_sql('CPIAUCSL')} AS cpi_index, {_latest_sql('UNRATE')} AS unemployment_rate,
           {_trend_sql()} AS rate_trend
    FROM numbered WHERE rn <= 6))
"""
register("rate_env", f"\nrate_env AS ({RATE_ENV_SQL})", ("numbered",))


@query("rate_environment", oracle=with_tables("SELECT * FROM rate_env", "rate_env"))
def q_rate_environment(spark, sf_dir):
    return MA.rate_environment(indicators(spark, lake_for(spark, sf_dir)))


# ---------------------------------------------------------------------------
# as-of rates and the market correlation view
# ---------------------------------------------------------------------------

def _asof_sub(sid: str, at: str) -> str:
    return (f"(SELECT value FROM indicator_values WHERE series_id = '{sid}' AND date <= {at} "
            f"ORDER BY date DESC LIMIT 1)")


@query("asof_rates", oracle=with_tables(f"""
SELECT d.date, {_asof_sub('FEDFUNDS', 'd.date')} AS fed_funds_rate,
       {_asof_sub('DGS10', 'd.date')} AS treasury_10y, {_asof_sub('DGS2', 'd.date')} AS treasury_2y
FROM (SELECT DISTINCT date FROM price_data) d""", "price_data", "indicator_values"))
def q_asof_rates(spark, sf_dir):
    lake = lake_for(spark, sf_dir)
    return AS.asof_rates(bind.price_data(lake), bind.market_indicator_values(lake))


def _mean_sql(rows: int) -> str:
    """Mean of the last ``rows`` closes (fewer at the start) as a difference of running totals."""
    return measure_at(rdiv(f"(now.total - coalesce(back{rows}.total, 0))", f"(least(now.k, {rows}) * 100)"), 2)


register("running", f"""
running AS (
  SELECT ticker, date, close, volume, {units('close')} AS u, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k,
         CAST(sum({units('close')}) OVER (PARTITION BY ticker ORDER BY date) AS BIGINT) AS total
  FROM price_data
)""", ("price_data",))


@query("market_correlation", headline=True, oracle=with_tables(f"""
SELECT now.ticker, sector, sub_sector, now.date, now.close AS price, now.volume, rates.fed_funds_rate, rates.treasury_10y, rates.treasury_2y,
       back1.close AS prev_close,
       CASE WHEN back1.u > 0 THEN {rratio("(now.u - back1.u) * 100", "back1.u", 4)} END AS daily_return_pct,
       {_mean_sql(20)} AS ma_20, {_mean_sql(50)} AS ma_50
FROM running now JOIN reits ON reits.ticker = now.ticker
LEFT JOIN running back1 ON back1.ticker = now.ticker AND back1.k = now.k - 1
LEFT JOIN running back20 ON back20.ticker = now.ticker AND back20.k = now.k - 20
LEFT JOIN running back50 ON back50.ticker = now.ticker AND back50.k = now.k - 50
JOIN (SELECT date, {_asof_sub('FEDFUNDS', 'days.date')} AS fed_funds_rate, {_asof_sub('DGS10', 'days.date')} AS treasury_10y, {_asof_sub('DGS2', 'days.date')} AS treasury_2y
      FROM (SELECT DISTINCT date FROM price_data) days) rates ON rates.date = now.date""", "running", "reits", "indicator_values"))
def q_market_correlation(spark, sf_dir):
    lake = lake_for(spark, sf_dir)
    prices = bind.price_data(lake)
    rates = AS.asof_rates(prices, bind.market_indicator_values(lake))
    return PR.market_correlation(prices, bind.reits(lake, listed_only=True), rates)


