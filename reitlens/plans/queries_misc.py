"""Registered data-quality, loading, scalar-function and prompt queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from reitlens import constants as K
from reitlens.functions import scalars as S
from reitlens.operators import filings as FI
from reitlens.operators import loaders as LO
from reitlens.operators import prompt as PM
from reitlens.operators import quality as DQ
from reitlens.operators import scores as SC
from reitlens.operators.fundamentals import latest_metric
from reitlens.plans.oracle import with_tables, with_whole_tables
from reitlens.plans.queries import METRIC_COLS
from reitlens.plans.queries_market import indicators
from reitlens.plans.queries_report import _inputs
from reitlens.plans.queries_text import RUN_TS, _WS
from reitlens.plans.registry import query
from reitlens.sources import bind, faults
from reitlens.sources.tables import lake_for


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _errors_sql(*rules: tuple[str, str]) -> str:
    parts = ", ".join(f"CASE WHEN {bad} THEN {msg} END" for bad, msg in rules)
    return f"CAST(to_json(list_filter([{parts}], lambda x: x IS NOT NULL)) AS VARCHAR)"


def _in(values) -> str:
    return ", ".join(_q(v) for v in values)


def _dq_out(tagged):
    return tagged.withColumn("dq_errors", F.to_json("dq_errors"))


def _norm_sql(expr: str) -> str:
    return f"upper(regexp_replace(regexp_replace({expr}, '^{_WS}+', ''), '{_WS}+$', ''))"


@query("dq_reits", oracle=with_tables(f"""
SELECT ticker, name, sector, sub_sector, market_cap, ipo_year, property_count, total_sqft,
       geographic_focus, dividend_yield, payout_ratio, latest_ffo_per_share,
       {_errors_sql(("coalesce(ticker, '') = ''", _q('REIT ticker must be non-empty')),
                    ("payout_ratio < 0 OR payout_ratio > 2.0",
                     "'Payout ratio ' || CAST(payout_ratio AS VARCHAR) || ' out of valid range [0, 2.0]'"),
                    ("market_cap < 0", _q('Market cap must be non-negative')),
                    (f"sector IS NOT NULL AND sector NOT IN ({_in(K.SECTORS)})", "'Unknown sector ' || sector"))}
       AS dq_errors
FROM (SELECT CASE WHEN n % 10 = 1 THEN '' ELSE ticker END AS ticker, name, CASE WHEN n % 10 = 3 THEN 'Timberland' ELSE sector END AS sector,
             sub_sector, market_cap, ipo_year, property_count, total_sqft, geographic_focus, dividend_yield,
             CASE n % 10 WHEN 2 THEN CAST(2.5 AS DOUBLE) WHEN 5 THEN CAST(-0.5 AS DOUBLE) ELSE payout_ratio END AS payout_ratio, latest_ffo_per_share
      FROM (SELECT *, CAST(substr(ticker, 2) AS BIGINT) AS n FROM reits_signed))""", "reits_signed"))
def q_dq_reits(spark, sf_dir):
    return _dq_out(DQ.dq_reits(faults.reits(bind.reits(lake_for(spark, sf_dir), signed_market_cap=True, listed_only=True))))


@query("dq_properties", oracle=with_tables(f"""
SELECT *, {_errors_sql(
    ("coalesce(property_id, '') = ''", _q('Property ID must be non-empty')),
    ("coalesce(reit_ticker, '') = ''", _q('REIT ticker must be non-empty')),
    ("occupancy_rate < 0.0 OR occupancy_rate > 1.0",
     "'Occupancy rate ' || CAST(occupancy_rate AS VARCHAR) || ' must be in [0, 1]'"),
    ("sqft < 0", _q('Square footage must be non-negative')),
    ("cap_rate < 0 OR cap_rate > 0.20", "'Cap rate ' || CAST(cap_rate AS VARCHAR) || ' out of expected range [0, 0.20]'"),
    (f"property_type IS NOT NULL AND property_type NOT IN ({_in(K.PROPERTY_TYPES)})", "'Unknown property type ' || property_type"),
    (f"status IS NOT NULL AND status NOT IN ({_in(K.PROPERTY_STATUSES)})", "'Unknown status ' || status"))} AS dq_errors
FROM (SELECT * EXCLUDE (n) REPLACE (
        CASE WHEN n = 7 THEN '' ELSE property_id END AS property_id, CASE WHEN n = 6 THEN '' ELSE reit_ticker END AS reit_ticker,
        CASE WHEN n = 4 THEN 'Land' ELSE property_type END AS property_type, CASE WHEN n = 5 THEN 'Unlisted' ELSE status END AS status,
        CASE WHEN n = 2 THEN CAST(-100 AS DOUBLE) ELSE sqft END AS sqft, CASE WHEN n = 1 THEN CAST(1.25 AS DOUBLE) ELSE occupancy_rate END AS occupancy_rate,
        CASE WHEN n = 3 THEN CAST(0.25 AS DOUBLE) ELSE cap_rate END AS cap_rate)
      FROM (SELECT *, CAST(substr(property_id, 2) AS BIGINT) % 11 AS n FROM properties))""", "properties"))
def q_dq_properties(spark, sf_dir):
    return _dq_out(DQ.dq_properties(faults.properties(bind.properties(lake_for(spark, sf_dir)))))


@query("dq_metrics", oracle=with_tables(f"""
SELECT {METRIC_COLS}, {_errors_sql(
    ("coalesce(reit_ticker, '') = ''", _q('REIT ticker must be non-empty')),
    ("quarter < 1 OR quarter > 4", "'Quarter must be 1-4, got ' || CAST(quarter AS VARCHAR)"),
    ("fiscal_year < 2000", "'Invalid fiscal year: ' || CAST(fiscal_year AS VARCHAR)"))} AS dq_errors
FROM (SELECT * REPLACE (CASE WHEN n = 3 THEN '' ELSE reit_ticker END AS reit_ticker, CASE WHEN n = 1 THEN 5 ELSE quarter END AS quarter,
                        CASE WHEN n = 2 THEN 1999 ELSE fiscal_year END AS fiscal_year)
      FROM (SELECT *, (CAST(substr(reit_ticker, 2) AS BIGINT) + fiscal_year) % 7 AS n FROM financial_metrics))""", "financial_metrics"))
def q_dq_metrics(spark, sf_dir):
    return _dq_out(DQ.dq_metrics(faults.metrics(bind.financial_metrics(lake_for(spark, sf_dir), reporting_only=True))))


@query("dq_indicators", oracle=with_tables(f"""
SELECT *, {_errors_sql(("coalesce(series_id, '') = ''", _q('Series ID must be non-empty')),
                       ("date IS NULL", _q('Date must be non-empty')))} AS dq_errors
FROM (SELECT * REPLACE (CASE WHEN month(date) = 2 THEN '' ELSE series_id END AS series_id, CASE WHEN month(date) = 3 THEN NULL ELSE date END AS date)
      FROM market_indicators)""", "market_indicators"))
def q_dq_indicators(spark, sf_dir):
    return _dq_out(DQ.dq_indicators(faults.indicators(indicators(spark, lake_for(spark, sf_dir)))))


def _filing_records(f):
    return f.select(
        S.filing_id("reit_ticker", "form_type", "filing_date").alias("filing_id"),
        "reit_ticker", "cik", "form_type", "filing_date", F.lit("Pending").alias("status"), "doc_id")


@query("dq_filings", oracle=with_tables(f"""
SELECT *, {_errors_sql(("coalesce(filing_id, '') = ''", _q('Filing ID must be non-empty')),
                       ("coalesce(cik, '') = ''", _q('CIK must be non-empty')),
                       (f"form_type IS NOT NULL AND form_type NOT IN ({_in(K.FORM_TYPES)})", "'Unknown form type ' || form_type"),
                       (f"status IS NOT NULL AND status NOT IN ({_in(K.FILING_STATUSES)})", "'Unknown status ' || status"))}
       AS dq_errors
FROM (SELECT CASE WHEN doc_id % 11 = 4 THEN '' ELSE
               replace(replace(reit_ticker || '_' || form_type || '_' || CAST(filing_date AS VARCHAR), '-', ''), ' ', '_') END AS filing_id,
             upper(trim(reit_ticker)) AS reit_ticker, CASE WHEN doc_id % 11 = 1 THEN '' ELSE cik END AS cik,
             CASE WHEN doc_id % 11 = 2 THEN 'S-11' ELSE form_type END AS form_type, filing_date,
             CASE WHEN doc_id % 11 = 3 THEN 'Lost' ELSE 'Pending' END AS status
      FROM filings)""", "filings"))
def q_dq_filings(spark, sf_dir):
    f = bind.filings(lake_for(spark, sf_dir)).drop("text")
    return _dq_out(DQ.dq_filings(faults.filings(_filing_records(f)).drop("doc_id")))


# ---------------------------------------------------------------------------
# loading semantics
# ---------------------------------------------------------------------------

REITS_COLS = ("ticker, name, sector, sub_sector, market_cap, ipo_year, property_count, total_sqft, "
              "geographic_focus, dividend_yield, payout_ratio, latest_ffo_per_share")


@query("load_reits", oracle=with_whole_tables(f"""
SELECT ticker, name, sector, sub_sector, market_cap, ipo_year, property_count, total_sqft, geographic_focus,
       CASE WHEN sector = 'Office' THEN dividend_yield + 1.0 ELSE dividend_yield END AS dividend_yield,
       payout_ratio, latest_ffo_per_share
FROM reits""", "reits"))
def q_load_reits(spark, sf_dir):
    r = bind.reits(lake_for(spark, sf_dir))
    update = (r.where(F.col("sector") == "Office")
              .withColumn("ticker", F.concat(F.lit(" "), F.lower("ticker"), F.lit("\t")))
              .withColumn("dividend_yield", F.col("dividend_yield") + F.lit(1.0)))
    return LO.load_reits(LO.with_load_seq([r, update], F.col("name")))


@query("load_metrics", oracle=with_whole_tables(f"SELECT {METRIC_COLS} FROM latest", "latest"))
def q_load_metrics(spark, sf_dir):
    m = bind.financial_metrics(lake_for(spark, sf_dir))
    again = latest_metric(m).withColumn("ffo_per_share", F.col("ffo_per_share") * F.lit(2.0))
    loaded = LO.load_metrics(LO.with_load_seq([m, again], F.col("created_at")))
    return latest_metric(loaded).drop("load_seq")


# ---------------------------------------------------------------------------
# scalar functions
# ---------------------------------------------------------------------------

@query("reit_scalars", oracle=with_whole_tables(f"""
SELECT ticker, {_norm_sql("(' ' || lower(ticker) || chr(9))")} AS normalized,
       CASE WHEN latest_ffo_per_share > 0 THEN latest_ffo_per_share * payout_ratio ELSE 0.0 END AS annual_dividend,
       CASE WHEN market_cap <= 0 OR latest_ffo_per_share <= 0 THEN 0.0
            WHEN market_cap / latest_ffo_per_share * payout_ratio <= 0 THEN 0.0
            ELSE latest_ffo_per_share / (market_cap / (market_cap / latest_ffo_per_share * payout_ratio)) END AS ffo_yield
FROM reits""", "reits"))
def q_reit_scalars(spark, sf_dir):
    r = bind.reits(lake_for(spark, sf_dir))
    return r.select(
        "ticker",
        S.norm_ticker(F.concat(F.lit(" "), F.lower("ticker"), F.lit("\t"))).alias("normalized"),
        S.annual_dividend("latest_ffo_per_share", "payout_ratio").alias("annual_dividend"),
        S.ffo_yield_master("market_cap", "latest_ffo_per_share", "payout_ratio").alias("ffo_yield"))


@query("metric_scalars", oracle=with_whole_tables("""
SELECT reit_ticker, period,
       CASE WHEN coalesce(affo_per_share, 0) > 0 THEN coalesce(dividend_per_share, 0) / affo_per_share ELSE 0.0 END AS affo_payout_ratio,
       CASE WHEN coalesce(ffo_per_share, 0) > 0 THEN coalesce(dividend_per_share, 0) / ffo_per_share ELSE 0.0 END AS ffo_payout_ratio,
       coalesce(ffo_growth_yoy, 0) - coalesce(dividend_growth_yoy, 0) AS growth_spread,
       CASE WHEN net_debt_to_ebitda <= 3.0 THEN 'A' WHEN net_debt_to_ebitda <= 5.0 THEN 'B'
            WHEN net_debt_to_ebitda <= 7.0 THEN 'C' ELSE 'D' END AS leverage_rating,
       CASE WHEN p <= 0.60 THEN 'Very Safe' WHEN p <= 0.75 THEN 'Safe' WHEN p <= 0.85 THEN 'Moderate'
            WHEN p <= 0.95 THEN 'Risky' ELSE 'Unsafe' END AS dividend_safety
FROM (SELECT *, CASE WHEN coalesce(affo_per_share, 0) > 0 THEN coalesce(dividend_per_share, 0) / affo_per_share
                     ELSE 0.0 END AS p FROM financial_metrics)""", "financial_metrics"))
def q_metric_scalars(spark, sf_dir):
    m = bind.financial_metrics(lake_for(spark, sf_dir))
    return m.select(
        "reit_ticker", "period",
        S.payout_ratio_model("dividend_per_share", "affo_per_share").alias("affo_payout_ratio"),
        S.payout_ratio_model("dividend_per_share", "ffo_per_share").alias("ffo_payout_ratio"),
        S.growth_spread("ffo_growth_yoy", "dividend_growth_yoy").alias("growth_spread"),
        S.leverage_rating("net_debt_to_ebitda").alias("leverage_rating"),
        S.dividend_safety_model("dividend_per_share", "affo_per_share").alias("dividend_safety"))


@query("filing_ids", oracle=with_tables("""
SELECT doc_id,
       replace(replace(reit_ticker || '_' || form_type || '_' || CAST(filing_date AS VARCHAR), '-', ''), ' ', '_') AS filing_id,
       CASE WHEN length(cik) < 10 THEN lpad(cik, 10, '0') ELSE cik END AS cik_padded,
       replace(accession_number, '-', '') AS accession_clean,
       'https://data.sec.gov/Archives/edgar/data/' || lpad(cik, 10, '0') || '/' || replace(accession_number, '-', '')
         || '/' || primary_document AS document_url,
       substr(text, 1, 500) AS record_text,
       CAST(length(text) AS BIGINT) AS text_chars
FROM filings""", "filings"))
def q_filing_ids(spark, sf_dir):
    f = bind.filings(lake_for(spark, sf_dir))
    return f.select(
        "doc_id",
        S.filing_id("reit_ticker", "form_type", "filing_date").alias("filing_id"),
        S.zero_pad("cik").alias("cik_padded"),
        S.accession_clean("accession_number").alias("accession_clean"),
        S.document_url("cik", "accession_number", "primary_document").alias("document_url"),
        S.excerpt("text", K.RECORD_TEXT_KEEP).alias("record_text"),
        F.char_length("text").cast("long").alias("text_chars"))


@query("metric_lookup", oracle=with_tables("""
SELECT filing_id, coalesce(ffo_per_share, 0.0) AS ffo_or_zero, occupancy_rate AS occupancy_or_null
FROM ingested""", "ingested"))
def q_metric_lookup(spark, sf_dir):
    out = FI.ingest_filings(bind.filings(lake_for(spark, sf_dir)), "10-K", F.lit(RUN_TS).cast("timestamp_ntz"))
    m = F.col("key_metrics_extracted")
    return out.select("filing_id", S.metric_lookup(m, "ffo_per_share", 0.0).alias("ffo_or_zero"),
                      S.metric_lookup(m, "occupancy_rate").alias("occupancy_or_null"))


# ---------------------------------------------------------------------------
# prompt
# ---------------------------------------------------------------------------

def _f(expr: str, d: int) -> str:
    return f"printf('%.{d}f', {expr})"


PROMPT_SQL = f"""
SELECT s.reit_ticker,
  'Analyze ' || s.reit_ticker || ' (' || coalesce(r.name, 'Unknown') || ') REIT:' || chr(10) || chr(10)
  || 'Composite Score: ' || {_f('s.composite_score', 1)} || '/100 (' || s.signal_rating || ')' || chr(10)
  || '- Fundamental: ' || {_f('s.fundamental_score', 0)} || '/100' || chr(10)
  || '- Valuation: ' || {_f('s.valuation_score', 0)} || '/100' || chr(10)
  || '- Momentum: ' || {_f('s.momentum_score', 0)} || '/100' || chr(10)
  || '- Macro: ' || {_f('s.macro_score', 0)} || '/100' || chr(10)
  || '- Sentiment: ' || {_f('s.sentiment_score', 0)} || '/100' || chr(10)
  || CASE WHEN r.ticker IS NULL THEN '' ELSE
       chr(10) || 'Sector: ' || r.sector || ' (' || coalesce(r.sub_sector, '') || ')' || chr(10)
       || 'Market Cap: $' || {_f('coalesce(r.market_cap, 0) / 1e9', 1)} || 'B' || chr(10)
       || 'Dividend Yield: ' || {_f('coalesce(r.dividend_yield, 0)', 1)} || '%' || chr(10)
       || 'FFO/Share: $' || {_f('coalesce(r.latest_ffo_per_share, 0)', 2)} || chr(10)
       || 'Payout Ratio: ' || {_f('coalesce(r.payout_ratio, 0) * 100.0', 0)} || '%' || chr(10) END
  || CASE WHEN l.reit_ticker IS NULL THEN '' ELSE
       chr(10) || 'Latest Quarter: FY' || CAST(l.fiscal_year AS VARCHAR) || ' Q' || CAST(l.quarter AS VARCHAR) || chr(10)
       || 'Same-Store NOI Growth: ' || {_f('coalesce(l.same_store_noi_growth, 0)', 1)} || '%' || chr(10)
       || 'FFO Growth YoY: ' || {_f('coalesce(l.ffo_growth_yoy, 0)', 1)} || '%' || chr(10)
       || 'Debt/EBITDA: ' || {_f('coalesce(l.net_debt_to_ebitda, 0)', 1)} || 'x' || chr(10)
       || 'Dividend Safety: ' || CASE WHEN p <= 0.60 THEN 'Very Safe' WHEN p <= 0.75 THEN 'Safe'
                                      WHEN p <= 0.85 THEN 'Moderate' WHEN p <= 0.95 THEN 'Risky' ELSE 'Unsafe' END
       || chr(10) END
  || CASE WHEN c.context_json IS NULL THEN '' ELSE chr(10) || 'Additional Context:' || chr(10) || c.context_json || chr(10) END
  || chr(10) || 'Provide a 2-3 paragraph investment analysis covering:' || chr(10)
  || '1. Key strengths and the investment thesis' || chr(10)
  || '2. Primary risks and concerns' || chr(10)
  || '3. Actionable recommendation (Buy/Hold/Sell with rationale)' || chr(10)
  || 'Rate your confidence in this analysis (0-100%).' || chr(10) AS prompt,
  'Analyze REIT ' || s.reit_ticker || ' based on:' || chr(10) || '- Composite Score: ' || coalesce(CAST(s.composite_score AS VARCHAR), 'N/A') || chr(10)
  || '- FFO/Share: $' || coalesce(CAST(l.ffo_per_share AS VARCHAR), 'N/A') || chr(10)
  || '- NOI Growth: ' || coalesce(CAST(l.same_store_noi_growth AS VARCHAR), 'N/A') || '%' || chr(10)
  || '- Dividend Yield: ' || coalesce(CAST(r.dividend_yield AS VARCHAR), 'N/A') || '%' || chr(10)
  || '- Debt/EBITDA: ' || coalesce(CAST(l.net_debt_to_ebitda AS VARCHAR), 'N/A') || 'x' || chr(10) || chr(10)
  || 'Provide concise investment recommendation (2-3 paragraphs).' AS short_prompt
FROM signals s
LEFT JOIN reits r ON r.ticker = s.reit_ticker
LEFT JOIN (SELECT *, CASE WHEN coalesce(affo_per_share, 0) > 0 THEN coalesce(dividend_per_share, 0) / affo_per_share
                          ELSE 0.0 END AS p FROM latest) l ON l.reit_ticker = s.reit_ticker
LEFT JOIN (
  SELECT reit_ticker, '{{' || chr(10) || '  "filings": [' || chr(10) || string_agg('    "' || form_type || ' ' || CAST(filing_date AS VARCHAR) || ': ' || said || '"', ',' || chr(10) ORDER BY rn)
         || chr(10) || '  ]' || chr(10) || '}}' AS context_json
  FROM (
    SELECT *, row_number() OVER (PARTITION BY reit_ticker ORDER BY filing_date DESC, accession_number DESC) AS rn
    FROM (SELECT *, substr(regexp_replace(regexp_extract(text, '(?i)(?:ffo|funds from operations)[^\n]*', 0), '[^A-Za-z0-9 .,;:%$()-]+', ' ', 'g'), 1, 160) AS said FROM filings)
    WHERE said <> '')
  WHERE rn <= 3 GROUP BY reit_ticker) c ON c.reit_ticker = s.reit_ticker
"""


@query("render_prompt", oracle=with_tables(PROMPT_SQL, "signals", "reits", "latest", "filings"))
def q_render_prompt(spark, sf_dir):
    reits, metrics, summary, env = _inputs(spark, sf_dir)
    sig = SC.generate_signals(reits, metrics, summary, env)
    context = PM.filing_context(bind.filings(lake_for(spark, sf_dir)))
    return PM.render_prompt(sig, reits, metrics, context)
