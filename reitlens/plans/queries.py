"""Registered queries: one per operator of the application, over whole tables.

Each builder reads the lake at ``sf_dir``, derives the REIT-shaped inputs with
``sources.bind`` and applies one operator.  The SQL next to it is the
independent DuckDB oracle over the same lake tables.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from reitlens.operators import fundamentals as FU
from reitlens.operators import peers as PE
from reitlens.plans.oracle import register, with_tables, with_whole_tables, xavg, xsum
from reitlens.plans.registry import query
from reitlens.sources import bind
from reitlens.sources.tables import Lake, lake_for


def _lake(spark: SparkSession, sf_dir: str) -> Lake:
    return lake_for(spark, sf_dir)


# ---------------------------------------------------------------------------
# fundamentals
# ---------------------------------------------------------------------------

PAYOUT_SQL = """
payout AS (
  SELECT *, dividend_per_share / nullif(greatest(affo_per_share, 0), 0) AS affo_share, dividend_per_share / nullif(greatest(ffo_per_share, 0), 0) AS ffo_share
  FROM financial_metrics WHERE quarter IS NOT NULL
)"""
register("payout", PAYOUT_SQL, ("financial_metrics",))


@query("reit_fundamentals", headline=True, oracle=with_whole_tables("""
SELECT ticker, name, sector, sub_sector, dividend_yield, payout_ratio,
       fiscal_year, quarter, created_at, same_store_noi, same_store_noi_growth, ffo_per_share, ffo_growth_yoy, affo_per_share,
       dividend_per_share, dividend_growth_yoy, net_debt_to_ebitda, interest_coverage,
       round(affo_share, 4) AS affo_payout_ratio, round(ffo_share, 4) AS ffo_payout_ratio,
       ['A', 'B', 'C', 'D'][4 - len(list_filter([3.0, 5.0, 7.0], lambda top: coalesce(net_debt_to_ebitda <= top, false)))] AS leverage_rating,
       ['Very Safe', 'Safe', 'Moderate', 'Risky', 'Unsafe'][5 - len(list_filter([0.60, 0.75, 0.85, 0.95], lambda top: coalesce(affo_share <= top, false)))] AS dividend_safety
FROM payout JOIN reits ON ticker = reit_ticker
""", "reits", "payout"))
def q_reit_fundamentals(spark, sf_dir):
    lake = _lake(spark, sf_dir)
    return FU.reit_fundamentals(bind.reits(lake), bind.financial_metrics(lake))


METRIC_COLS = ("reit_ticker, period, fiscal_year, quarter, total_revenue, same_store_noi, "
               "same_store_noi_growth, ffo_per_share, affo_per_share, ffo_growth_yoy, "
               "net_debt_to_ebitda, interest_coverage, weighted_avg_cap_rate, dividend_per_share, "
               "dividend_growth_yoy, created_at")

LATEST_SQL = f"""
latest AS (
  SELECT {METRIC_COLS} FROM (
    SELECT *, row_number() OVER (PARTITION BY reit_ticker
                                 ORDER BY fiscal_year DESC, quarter DESC, period) AS rn
    FROM financial_metrics) WHERE rn = 1
)"""

ETL_YEAR = 2020
register("latest", LATEST_SQL, ("financial_metrics",))


@query("latest_metric", oracle=with_whole_tables(f"SELECT {METRIC_COLS} FROM latest", "latest"))
def q_latest_metric(spark, sf_dir):
    return FU.latest_metric(bind.financial_metrics(_lake(spark, sf_dir)))


@query("join_latest_metric", oracle=with_whole_tables("""
SELECT r.ticker, r.name, r.sector, r.sub_sector, r.dividend_yield, r.payout_ratio,
       fm.ffo_per_share, fm.affo_per_share, fm.same_store_noi_growth, fm.ffo_growth_yoy,
       fm.net_debt_to_ebitda, fm.interest_coverage, fm.weighted_avg_cap_rate, fm.dividend_growth_yoy
FROM reits r
LEFT JOIN financial_metrics fm
  ON r.ticker = fm.reit_ticker
 AND fm.fiscal_year = (SELECT MAX(fiscal_year) FROM financial_metrics x WHERE x.reit_ticker = r.ticker)
 AND fm.quarter = (SELECT MAX(quarter) FROM financial_metrics y
                   WHERE y.reit_ticker = r.ticker AND y.fiscal_year = fm.fiscal_year)
""", "reits", "financial_metrics"))
def q_join_latest_metric(spark, sf_dir):
    lake = _lake(spark, sf_dir)
    return FU.join_latest_metric(bind.reits(lake), bind.financial_metrics(lake))


@query("filter_fiscal_year", oracle=with_whole_tables(
    f"SELECT {METRIC_COLS} FROM financial_metrics WHERE fiscal_year = {ETL_YEAR}", "financial_metrics"))
def q_filter_fiscal_year(spark, sf_dir):
    return FU.filter_fiscal_year(bind.financial_metrics(_lake(spark, sf_dir)), ETL_YEAR)


@query("get_by_sector", oracle=with_whole_tables(
    "SELECT * FROM reits WHERE sector = 'Office'", "reits"))
def q_get_by_sector(spark, sf_dir):
    return FU.by_sector(bind.reits(_lake(spark, sf_dir)), "Office")


@query("get_by_ticker", oracle=with_tables(
    "SELECT * FROM reits WHERE ticker = upper(trim(' r7 '))", "reits"))
def q_get_by_ticker(spark, sf_dir):
    return FU.by_ticker(bind.reits(_lake(spark, sf_dir), listed_only=True), " r7 ")


PEER_AVG_SQL = f"""
peer_avg AS (
  SELECT sub_sector,
         {xavg('ffo_per_share')} AS avg_ffo,
         {xavg('same_store_noi_growth')} AS avg_noi_growth,
         {xavg('net_debt_to_ebitda')} AS avg_leverage,
         {xavg('dividend_yield')} AS avg_yield
  FROM reits r JOIN financial_metrics fm ON r.ticker = fm.reit_ticker
  WHERE fm.fiscal_year = {ETL_YEAR}
  GROUP BY sub_sector
)"""


register("peer_avg", PEER_AVG_SQL, ("reits", "financial_metrics"))


@query("agg_peer_avg", oracle=with_whole_tables("SELECT * FROM peer_avg", "peer_avg"))
def q_agg_peer_avg(spark, sf_dir):
    lake = _lake(spark, sf_dir)
    return PE.agg_peer_avg(bind.reits(lake), bind.financial_metrics(lake), ETL_YEAR)


@query("peer_comparison_etl", oracle=with_whole_tables(f"""
SELECT fm.reit_ticker, fm.ffo_per_share,
       fm.ffo_per_share - pa.avg_ffo AS ffo_vs_peers,
       fm.same_store_noi_growth - pa.avg_noi_growth AS noi_vs_peers,
       fm.net_debt_to_ebitda - pa.avg_leverage AS leverage_vs_peers,
       r.dividend_yield - pa.avg_yield AS yield_vs_peers
FROM financial_metrics fm
JOIN reits r ON fm.reit_ticker = r.ticker
JOIN peer_avg pa ON r.sub_sector = pa.sub_sector
WHERE fm.fiscal_year = {ETL_YEAR}
""", "peer_avg"))
def q_peer_comparison_etl(spark, sf_dir):
    lake = _lake(spark, sf_dir)
    return PE.peer_comparison_etl(bind.reits(lake), bind.financial_metrics(lake), ETL_YEAR)


@query("agg_sector_benchmarks_etl", oracle=with_whole_tables(f"""
SELECT r.sector, COUNT(*) AS reit_count, {xavg('fm.ffo_per_share')} AS avg_ffo,
       {xavg('fm.same_store_noi_growth')} AS avg_noi_growth, {xavg('fm.net_debt_to_ebitda')} AS avg_leverage,
       {xavg('r.dividend_yield')} AS avg_yield, {xavg('fm.weighted_avg_cap_rate')} AS avg_cap_rate
FROM reits r JOIN financial_metrics fm ON r.ticker = fm.reit_ticker
WHERE fm.fiscal_year = {ETL_YEAR}
GROUP BY r.sector
""", "reits", "financial_metrics"))
def q_agg_sector_benchmarks_etl(spark, sf_dir):
    lake = _lake(spark, sf_dir)
    return PE.agg_sector_benchmarks_etl(bind.reits(lake), bind.financial_metrics(lake), ETL_YEAR)


@query("agg_sector_benchmarks", oracle=with_whole_tables(f"""
SELECT r.sector, COUNT(*) AS reit_count,
       round({xavg('coalesce(l.ffo_per_share, 0)')}, 2) AS avg_ffo,
       round({xavg('coalesce(l.same_store_noi_growth, 0)')}, 2) AS avg_noi_growth,
       round({xavg('coalesce(l.net_debt_to_ebitda, 0)')}, 2) AS avg_leverage,
       round({xavg('coalesce(r.dividend_yield, 0)')}, 2) AS avg_yield,
       round({xavg('coalesce(l.weighted_avg_cap_rate, 0)')}, 4) AS avg_cap_rate
FROM latest l JOIN reits r ON l.reit_ticker = r.ticker
GROUP BY r.sector
""", "reits", "latest"))
def q_agg_sector_benchmarks(spark, sf_dir):
    lake = _lake(spark, sf_dir)
    return PE.agg_sector_benchmarks(bind.reits(lake), bind.financial_metrics(lake))


@query("peer_comparison", oracle=with_whole_tables(f"""
SELECT ticker, sector, CAST(n - 1 AS INTEGER) AS peer_count,
       CASE WHEN n > 1 THEN ffo END AS ffo_per_share,
       CAST(CASE WHEN n > 1 THEN ffo_rank ELSE 1 END AS INTEGER) AS ffo_rank,
       CASE WHEN n > 1 THEN round(ffo - (s_ffo - ffo) / (n - 1), 2) END AS ffo_vs_peers,
       CASE WHEN n > 1 THEN noi END AS noi_growth,
       CAST(CASE WHEN n > 1 THEN noi_rank ELSE 1 END AS INTEGER) AS noi_growth_rank,
       CASE WHEN n > 1 THEN round(noi - (s_noi - noi) / (n - 1), 2) END AS noi_growth_vs_peers,
       CAST(CASE WHEN n > 1 THEN y_rank ELSE 1 END AS INTEGER) AS dividend_yield_rank,
       CASE WHEN n > 1 THEN lev END AS leverage,
       CASE WHEN n > 1 THEN round(lev - (s_lev - lev) / (n - 1), 2) END AS leverage_vs_peers,
       CASE WHEN n > 1 THEN round((s_ffo - ffo) / (n - 1), 2) END AS avg_peer_ffo,
       CASE WHEN n > 1 THEN round((s_noi - noi) / (n - 1), 2) END AS avg_peer_noi_growth,
       CASE WHEN n > 1 THEN round((s_lev - lev) / (n - 1), 2) END AS avg_peer_leverage
FROM (
  SELECT m.*, yr.y_rank,
         rank() OVER (PARTITION BY m.sector ORDER BY ffo DESC) AS ffo_rank,
         rank() OVER (PARTITION BY m.sector ORDER BY noi DESC) AS noi_rank,
         count(*) OVER (PARTITION BY m.sector) AS n,
         {xsum('ffo', 'OVER (PARTITION BY m.sector)')} AS s_ffo,
         {xsum('noi', 'OVER (PARTITION BY m.sector)')} AS s_noi,
         {xsum('lev', 'OVER (PARTITION BY m.sector)')} AS s_lev
  FROM (SELECT r.ticker, r.sector, coalesce(l.ffo_per_share, 0) AS ffo,
               coalesce(l.same_store_noi_growth, 0) AS noi, coalesce(l.net_debt_to_ebitda, 0) AS lev
        FROM latest l JOIN reits r ON l.reit_ticker = r.ticker) m
  JOIN (SELECT ticker, rank() OVER (PARTITION BY sector ORDER BY dividend_yield DESC) AS y_rank
        FROM reits) yr ON yr.ticker = m.ticker
)
UNION ALL
SELECT l.reit_ticker, 'Specialty', 0, NULL, 1, NULL, NULL, 1, NULL, 1, NULL, NULL, NULL, NULL, NULL
FROM latest l WHERE l.reit_ticker NOT IN (SELECT ticker FROM reits)
""", "reits", "latest"))
def q_peer_comparison(spark, sf_dir):
    lake = _lake(spark, sf_dir)
    return PE.peer_comparison(bind.reits(lake), bind.financial_metrics(lake))


@query("sector_peers", oracle=with_whole_tables("""
SELECT s.ticker, s.sector, p.ticker AS peer_ticker
FROM reits s JOIN reits p ON s.sector = p.sector AND p.ticker <> s.ticker
WHERE s.ticker = 'R3'
""", "reits"))
def q_sector_peers(spark, sf_dir):
    lake = _lake(spark, sf_dir)
    return PE.sector_peers(bind.reits(lake), [" r3"])


SAFETY_BASE = """
both_keys AS (
  SELECT ticker FROM reits UNION SELECT reit_ticker FROM latest
),
both_rows AS (
  SELECT r.ticker, r.dividend_yield, r.payout_ratio, r.market_cap, l.*,
         CASE WHEN coalesce(l.affo_per_share, 0) > 0
              THEN coalesce(l.dividend_per_share, 0) / coalesce(l.affo_per_share, 0) ELSE 0.0 END AS p,
         CASE WHEN coalesce(l.ffo_per_share, 0) > 0
              THEN coalesce(l.dividend_per_share, 0) / coalesce(l.ffo_per_share, 0) ELSE 0.0 END AS fp,
         coalesce(l.ffo_growth_yoy, 0) - coalesce(l.dividend_growth_yoy, 0) AS spread
  FROM latest l JOIN reits r ON l.reit_ticker = r.ticker
)"""
register("safety_base", SAFETY_BASE, ("reits", "latest"))


@query("dividend_safety", oracle=with_whole_tables("""
SELECT ticker, round(p, 4) AS affo_payout_ratio, round(fp, 4) AS ffo_payout_ratio,
       CASE WHEN p <= 0.60 THEN 'Very Safe' WHEN p <= 0.75 THEN 'Safe' WHEN p <= 0.85 THEN 'Moderate'
            WHEN p <= 0.95 THEN 'Risky' ELSE 'Unsafe' END AS dividend_safety,
       round(CASE WHEN p <= 1.0 THEN 1.0 - p ELSE 0.0 END, 4) AS affo_coverage,
       round(spread, 2) AS ffo_growth_vs_div_growth,
       score AS safety_score,
       CASE WHEN score >= 70 THEN 'Low' WHEN score >= 40 THEN 'Moderate' ELSE 'High' END AS risk_level,
       CAST(NULL AS VARCHAR) AS error
FROM (
  SELECT *, greatest(0.0, least(100.0, CAST(50
        + CASE WHEN p <= 0.60 THEN 30 WHEN p <= 0.70 THEN 20 WHEN p <= 0.80 THEN 10 WHEN p > 0.90 THEN -20 ELSE 0 END
        + CASE WHEN spread > 2.0 THEN 15 WHEN spread > 0 THEN 5 WHEN spread < -2.0 THEN -15 ELSE 0 END
        + CASE WHEN coalesce(ffo_growth_yoy, 0) > 5.0 THEN 5 WHEN coalesce(ffo_growth_yoy, 0) < 0 THEN -10 ELSE 0 END
        AS DOUBLE))) AS score
  FROM both_rows)
UNION ALL
SELECT ticker, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Insufficient data'
FROM both_keys WHERE ticker NOT IN (SELECT ticker FROM both_rows)
""", "safety_base"))
def q_dividend_safety(spark, sf_dir):
    lake = _lake(spark, sf_dir)
    return PE.dividend_safety(bind.reits(lake), bind.financial_metrics(lake))


@query("valuation", oracle=with_whole_tables(f"""
SELECT b.ticker,
       round(CASE WHEN fy > 0 THEN 1.0 / fy ELSE 0.0 END, 2) AS p_ffo,
       CASE WHEN fy <> 0 THEN round(fy * 100.0, 2) ELSE 0.0 END AS ffo_yield,
       b.dividend_yield,
       round(coalesce(b.dividend_yield, 0) - y.avg_y, 2) AS dividend_yield_vs_sector,
       round(y.avg_y, 2) AS avg_sector_yield,
       round(CASE WHEN coalesce(same_store_noi, 0) * 1.15 > 0
                  THEN coalesce(market_cap, 0) / (coalesce(same_store_noi, 0) * 1.15 * 1e6) ELSE 0.0 END, 1) AS ev_ebitda,
       weighted_avg_cap_rate AS cap_rate,
       CAST(NULL AS VARCHAR) AS error
FROM (SELECT *, CASE WHEN coalesce(payout_ratio, 0) > 0
                     THEN coalesce(dividend_yield, 0) / coalesce(payout_ratio, 0) ELSE 0.0 END AS fy
      FROM both_rows) b
JOIN (SELECT ticker,
             CASE WHEN count(*) OVER (PARTITION BY sector) > 1
                  THEN ({xsum('coalesce(dividend_yield, 0)', 'OVER (PARTITION BY sector)')} - coalesce(dividend_yield, 0))
                       / (count(*) OVER (PARTITION BY sector) - 1)
                  ELSE coalesce(dividend_yield, 0) END AS avg_y
      FROM reits) y ON y.ticker = b.ticker
UNION ALL
SELECT ticker, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Insufficient data'
FROM both_keys WHERE ticker NOT IN (SELECT ticker FROM both_rows)
""", "safety_base"))
def q_valuation(spark, sf_dir):
    lake = _lake(spark, sf_dir)
    return PE.valuation(bind.reits(lake), bind.financial_metrics(lake))
