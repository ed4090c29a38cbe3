"""Registered property, scoring and report queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from reitlens import constants as K
from reitlens.operators import macro as MA
from reitlens.operators import prices as PR
from reitlens.operators import properties as PP
from reitlens.operators import scores as SC
from reitlens.operators.fundamentals import latest_metric
from reitlens.plans.oracle import register, with_tables, with_whole_tables, xavg
from reitlens.plans.queries_market import _summary_sql, indicators
from reitlens.plans.registry import query
from reitlens.sources import bind
from reitlens.sources.tables import lake_for

# ---------------------------------------------------------------------------
# properties
# ---------------------------------------------------------------------------


PROPERTY_SQL = f"""
busiest AS (
  SELECT reit_ticker, max(here) AS most FROM (SELECT reit_ticker, msa, count(*) AS here FROM properties GROUP BY ALL) GROUP BY reit_ticker
), operating AS (
  SELECT reit_ticker, count(*) AS n, sum(sqft) AS area, {xavg('occupancy_rate')} AS occupied, {xavg('annual_rent_psf')} AS rent, {xavg('cap_rate')} AS cap,
         {xavg('lease_expiry_weighted_avg')} AS lease, count(*) FILTER (occupancy_rate >= 0.95) AS full_ones, count(*) FILTER (occupancy_rate < 0.85) AS empty_ones,
         len(list_distinct(list(state))) AS states, len(list_distinct(list(msa) FILTER (msa IS NOT NULL))) AS msas
  FROM properties WHERE status = 'Operating' GROUP BY reit_ticker
)"""
register("operating", PROPERTY_SQL, ("properties",))


@query("property_analysis", headline=True, oracle=with_whole_tables("""
SELECT ticker, name, sector, n AS total_properties, area AS total_sqft, occupied AS avg_occupancy_rate, rent AS avg_rent_psf, cap AS avg_cap_rate,
       lease AS avg_lease_expiry_years, full_ones AS high_occupancy_count, empty_ones AS low_occupancy_count,
       CAST(states AS BIGINT) AS state_count, CAST(coalesce(msas, 0) AS BIGINT) AS msa_count, most AS max_msa_concentration
FROM operating JOIN busiest USING (reit_ticker) JOIN reits ON ticker = reit_ticker""", "reits", "operating"))
def q_property_analysis(spark, sf_dir):
    lake = lake_for(spark, sf_dir)
    return PP.property_analysis(bind.reits(lake), bind.properties(lake))


@query("max_msa_count", oracle=with_tables("""
SELECT reit_ticker, max(cnt) AS max_msa_concentration
FROM (SELECT reit_ticker, msa, count(*) AS cnt FROM properties GROUP BY 1, 2) GROUP BY 1""",
                                           "properties"))
def q_max_msa_count(spark, sf_dir):
    return PP.max_msa_count(bind.properties(lake_for(spark, sf_dir)))


@query("property_values", oracle=with_tables("""
SELECT property_id, reit_ticker, sqft * annual_rent_psf AS annual_rent,
       sqft * annual_rent_psf * occupancy_rate * (1.0 - 0.35) AS noi_estimate,
       CASE WHEN cap_rate > 0 THEN sqft * annual_rent_psf * occupancy_rate * (1.0 - 0.35) / cap_rate
            ELSE 0.0 END AS value_at_cap,
       CASE WHEN acquisition_cost > 0
            THEN (current_book_value - acquisition_cost) / acquisition_cost ELSE 0.0 END AS appreciation
FROM properties""", "properties"))
def q_property_values(spark, sf_dir):
    return PP.property_values(bind.properties(lake_for(spark, sf_dir)))


# ---------------------------------------------------------------------------
# scores (SQL twins)
# ---------------------------------------------------------------------------

def _clamp(expr: str) -> str:
    return f"greatest(0.0, least(100.0, CAST({expr} AS DOUBLE)))"


FSCORE = f"""
fscore AS (
  SELECT reit_ticker AS ticker, {_clamp('''50.0
    + CASE WHEN coalesce(ffo_growth_yoy, 0) > 10 THEN 20 WHEN coalesce(ffo_growth_yoy, 0) > 5 THEN 15
           WHEN coalesce(ffo_growth_yoy, 0) > 0 THEN 10 WHEN coalesce(ffo_growth_yoy, 0) > -5 THEN 0 ELSE -15 END
    + CASE WHEN coalesce(same_store_noi_growth, 0) > 5 THEN 20 WHEN coalesce(same_store_noi_growth, 0) > 2 THEN 15
           WHEN coalesce(same_store_noi_growth, 0) > 0 THEN 8 ELSE -10 END
    + CASE WHEN coalesce(net_debt_to_ebitda, 0) < 3.0 THEN 10 WHEN coalesce(net_debt_to_ebitda, 0) < 5.0 THEN 5
           WHEN coalesce(net_debt_to_ebitda, 0) > 7.0 THEN -10 ELSE 0 END
    + CASE WHEN coalesce(interest_coverage, 0) > 5 THEN 5 WHEN coalesce(interest_coverage, 0) > 3 THEN 3 ELSE 0 END''')}
    AS fundamental_score
  FROM latest
)"""

VSCORE = f"""
vscore AS (
  SELECT ticker, {_clamp('''50.0
    + least(coalesce(dividend_yield, 0) / CAST(8.0 AS DOUBLE), CAST(1.0 AS DOUBLE)) * CAST(30.0 AS DOUBLE)
    + CASE WHEN coalesce(payout_ratio, 0) >= 0.50 AND coalesce(payout_ratio, 0) <= 0.75 THEN 15
           WHEN coalesce(payout_ratio, 0) >= 0.40 AND coalesce(payout_ratio, 0) <= 0.85 THEN 8
           WHEN coalesce(payout_ratio, 0) > 0.90 THEN -15 ELSE 0 END
    + CASE WHEN coalesce(latest_ffo_per_share, 0) > 0 THEN
           CASE WHEN (CASE WHEN coalesce(payout_ratio, 0) > 0 THEN coalesce(dividend_yield, 0) / coalesce(payout_ratio, 0) ELSE 0.0 END) > 0.08 THEN 10
                WHEN (CASE WHEN coalesce(payout_ratio, 0) > 0 THEN coalesce(dividend_yield, 0) / coalesce(payout_ratio, 0) ELSE 0.0 END) > 0.06 THEN 5
                ELSE 0 END
           ELSE 0 END''')} AS valuation_score
  FROM reits
)"""

PMALL = f"\npmall AS ({_summary_sql('hist')})"

MSCORE = f"""
mscore AS (
  SELECT ticker, {_clamp('''50.0
    + CASE WHEN coalesce(return_3m, 0) > 10 THEN 25 WHEN coalesce(return_3m, 0) > 5 THEN 15
           WHEN coalesce(return_3m, 0) > 0 THEN 8 WHEN coalesce(return_3m, 0) > -10 THEN -5 ELSE -20 END
    + CASE WHEN coalesce(return_1y, 0) > 20 THEN 15 WHEN coalesce(return_1y, 0) > 10 THEN 10
           WHEN coalesce(return_1y, 0) > 0 THEN 5 WHEN coalesce(return_1y, 0) < -15 THEN -15 ELSE 0 END
    + CASE WHEN pct_from_ma_200 IS NULL THEN 0 WHEN pct_from_ma_200 > 10 THEN 10
           WHEN pct_from_ma_200 > 0 THEN 5 WHEN pct_from_ma_200 < -10 THEN -10 ELSE 0 END''')} AS momentum_score
  FROM pmall
)"""

MACRO = f"""
macro AS (
  SELECT {_clamp('''50.0
    + CASE WHEN rate_assessment = 'Accommodative' THEN 20 WHEN rate_assessment = 'Restrictive' THEN -20 ELSE 0 END
    + CASE WHEN curve_assessment IN ('Normal', 'Steep') THEN 10 WHEN curve_assessment = 'Inverted' THEN -15 ELSE 0 END
    + CASE WHEN rate_trend = 'Falling' THEN 15 WHEN rate_trend = 'Rising' THEN -10 ELSE 0 END
    + CASE WHEN unemployment_rate IS NULL THEN 0
           WHEN unemployment_rate >= 3.5 AND unemployment_rate <= 5.0 THEN 5
           WHEN unemployment_rate > 6.0 THEN -10 ELSE 0 END''')} AS macro_score
  FROM rate_env
)"""

SSCORE = f"""
sscore AS (
  SELECT coalesce(r.ticker, l.reit_ticker) AS ticker, {_clamp('''50.0
    + CASE WHEN l.reit_ticker IS NOT NULL THEN
        CASE WHEN coalesce(l.dividend_growth_yoy, 0) > 5 THEN 15 WHEN coalesce(l.dividend_growth_yoy, 0) > 0 THEN 8
             WHEN coalesce(l.dividend_growth_yoy, 0) < 0 THEN -10 ELSE 0 END ELSE 0 END
    + CASE WHEN l.reit_ticker IS NOT NULL THEN
        CASE WHEN coalesce(l.same_store_noi_growth, 0) > 3 THEN 10
             WHEN coalesce(l.same_store_noi_growth, 0) < 0 THEN -10 ELSE 0 END ELSE 0 END
    + CASE WHEN r.ticker IS NOT NULL THEN
        CASE WHEN coalesce(r.market_cap, 0) > 50e9 THEN 10 WHEN coalesce(r.market_cap, 0) > 20e9 THEN 5 ELSE 0 END
      ELSE 0 END''')} AS sentiment_score
  FROM reits r FULL JOIN latest l ON r.ticker = l.reit_ticker
)"""

SIGNALS = """
signals AS (
  SELECT reit_ticker, fundamental_score, valuation_score, momentum_score, macro_score, sentiment_score,
         composite_score,
         CASE WHEN composite_score >= 80 THEN 'Strong Buy' WHEN composite_score >= 65 THEN 'Buy'
              WHEN composite_score >= 35 THEN 'Hold' WHEN composite_score >= 20 THEN 'Sell'
              ELSE 'Strong Sell' END AS signal_rating,
         CASE WHEN composite_score >= 85 THEN 'Very Bullish' WHEN composite_score >= 65 THEN 'Bullish'
              WHEN composite_score >= 40 THEN 'Neutral' WHEN composite_score >= 20 THEN 'Bearish'
              ELSE 'Very Bearish' END AS sentiment
  FROM (
    SELECT *, CAST(printf('%.2f', fundamental_score * 0.3 + valuation_score * 0.25 + momentum_score * 0.2
                              + macro_score * 0.15 + sentiment_score * 0.1) AS DOUBLE) AS composite_score
    FROM (
      SELECT r.ticker AS reit_ticker,
             coalesce(f.fundamental_score, 50.0) AS fundamental_score,
             coalesce(v.valuation_score, 50.0) AS valuation_score,
             coalesce(m.momentum_score, 50.0) AS momentum_score,
             coalesce(ma.macro_score, 50.0) AS macro_score,
             coalesce(s.sentiment_score, 50.0) AS sentiment_score
      FROM reits r
      LEFT JOIN fscore f ON f.ticker = r.ticker
      LEFT JOIN vscore v ON v.ticker = r.ticker
      LEFT JOIN sscore s ON s.ticker = r.ticker
      LEFT JOIN mscore m ON m.ticker = r.ticker
      CROSS JOIN macro ma))
)"""

register("fscore", FSCORE, ("latest",))
register("vscore", VSCORE, ("reits",))
register("pmall", PMALL, ("hist",))
register("mscore", MSCORE, ("pmall",))
register("macro", MACRO, ("rate_env",))
register("sscore", SSCORE, ("reits", "latest"))
register("signals", SIGNALS, ("reits", "fscore", "vscore", "sscore", "mscore", "macro"))


def _summary(lake):
    """The price summary over the whole history, which the momentum score reads."""
    return PR.price_metrics(bind.price_data(lake))


def _env(spark, lake):
    return MA.rate_environment(indicators(spark, lake))


def _inputs(spark, sf_dir):
    lake = lake_for(spark, sf_dir)
    return bind.reits(lake, listed_only=True), bind.financial_metrics(lake, reporting_only=True), _summary(lake), _env(spark, lake)


@query("score_fundamental", oracle=with_whole_tables("SELECT * FROM fscore", "fscore"))
def q_score_fundamental(spark, sf_dir):
    return SC.fundamental_score(latest_metric(bind.financial_metrics(lake_for(spark, sf_dir))))


@query("score_valuation", oracle=with_whole_tables("SELECT * FROM vscore", "vscore"))
def q_score_valuation(spark, sf_dir):
    return SC.valuation_score(bind.reits(lake_for(spark, sf_dir)))


@query("score_momentum", oracle=with_tables("SELECT * FROM mscore", "mscore"))
def q_score_momentum(spark, sf_dir):
    return SC.momentum_score(_summary(lake_for(spark, sf_dir)))


@query("score_macro", oracle=with_tables("SELECT * FROM macro", "macro"))
def q_score_macro(spark, sf_dir):
    return SC.macro_score(_env(spark, lake_for(spark, sf_dir)))


@query("score_sentiment", oracle=with_whole_tables("SELECT * FROM sscore", "sscore"))
def q_score_sentiment(spark, sf_dir):
    lake = lake_for(spark, sf_dir)
    return SC.sentiment_score(bind.reits(lake), latest_metric(bind.financial_metrics(lake)))


@query("generate_signal", oracle=with_tables("SELECT * FROM signals", "signals"))
def q_generate_signal(spark, sf_dir):
    return SC.generate_signals(*_inputs(spark, sf_dir))


@query("compare_signals", oracle=with_tables("""
SELECT CAST(row_number() OVER (ORDER BY composite_score DESC, reit_ticker) AS INTEGER) AS rank,
       reit_ticker AS ticker, composite_score, signal_rating AS rating,
       fundamental_score AS fundamental, valuation_score AS valuation, momentum_score AS momentum,
       macro_score AS macro, sentiment_score AS sentiment
FROM signals""", "signals"))
def q_compare_signals(spark, sf_dir):
    return SC.compare_signals(SC.generate_signals(*_inputs(spark, sf_dir)))


def _list_sql(*items: tuple[str, str]) -> str:
    parts = ", ".join(f"CASE WHEN {c} THEN {m} END" for c, m in items)
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


REPORT_SQL = f"""
report AS (
  SELECT s.*,
         {_list_sql(('fundamental_score < 40', _q(K.RISK_FUNDAMENTAL)),
                    ('valuation_score < 35', _q(K.RISK_VALUATION)),
                    ('macro_score < 40', _q(K.RISK_MACRO)),
                    ('l.reit_ticker IS NOT NULL AND l.net_debt_to_ebitda > 6.0',
                     "'High leverage at ' || printf('%.1f', l.net_debt_to_ebitda) || 'x Debt/EBITDA'"))} AS key_risks,
         {_list_sql(('fundamental_score > 70', _q(K.OPP_FUNDAMENTAL)),
                    ('valuation_score > 70', _q(K.OPP_VALUATION)),
                    ('macro_score > 70', _q(K.OPP_MACRO)))} AS key_opportunities,
         {_list_sql(('l.reit_ticker IS NOT NULL', _q(K.SOURCE_FUNDAMENTALS)),
                    ('true', _q(K.SOURCE_PRICES)), ('true', _q(K.SOURCE_MACRO)))} AS data_sources,
         round((CASE WHEN l.reit_ticker IS NOT NULL THEN 1 ELSE 0 END + 2) / 3.0, 2) AS confidence_score
  FROM signals s LEFT JOIN latest l ON l.reit_ticker = s.reit_ticker
)"""
register("report", REPORT_SQL, ("signals", "latest"))


@query("full_report", headline=True, oracle=with_tables("""
SELECT reit_ticker, fundamental_score, valuation_score, momentum_score, macro_score, sentiment_score,
       composite_score, signal_rating, sentiment,
       CAST(to_json(key_risks) AS VARCHAR) AS key_risks, CAST(to_json(key_opportunities) AS VARCHAR) AS key_opportunities,
       CAST(to_json(data_sources) AS VARCHAR) AS data_sources, confidence_score
FROM report""", "report"))
def q_full_report(spark, sf_dir):
    rep = SC.full_report(*_inputs(spark, sf_dir))
    return rep.select(*[F.to_json(c).alias(c) if c in ("key_risks", "key_opportunities", "data_sources")
                        else F.col(c) for c in rep.columns])


RUN_TS = "2024-06-28 12:00:00"


@query("signals_sink_rows", oracle=with_tables(f"""
SELECT reit_ticker || '_' || strftime(TIMESTAMP '{RUN_TS}', '%Y%m%d_%H%M%S') AS signal_id,
       reit_ticker AS ticker, TIMESTAMP '{RUN_TS}' AS generated_at,
       coalesce(composite_score, 50.0) AS composite_score, coalesce(fundamental_score, 50.0) AS fundamental_score,
       coalesce(valuation_score, 50.0) AS valuation_score, coalesce(momentum_score, 50.0) AS momentum_score,
       coalesce(macro_score, 50.0) AS macro_score, coalesce(sentiment_score, 50.0) AS sentiment_score,
       coalesce(signal_rating, 'Hold') AS signal_rating, '' AS ai_analysis,
       CAST(to_json(key_risks) AS VARCHAR) AS key_risks, CAST(to_json(key_opportunities) AS VARCHAR) AS key_opportunities,
       coalesce(confidence_score, 0.5) AS confidence_score
FROM report""", "report"))
def q_signals_sink_rows(spark, sf_dir):
    rep = SC.full_report(*_inputs(spark, sf_dir))
    return SC.signals_for_sink(rep, F.lit(RUN_TS).cast("timestamp_ntz"))
