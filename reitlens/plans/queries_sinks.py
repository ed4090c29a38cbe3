"""Registered sink queries: write in batches, some of them twice, and read back what the sink holds."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from reitlens import constants as K
from reitlens import schemas
from reitlens.operators import asof as AS
from reitlens.operators import filings as FI
from reitlens.operators import fundamentals as FU
from reitlens.operators import peers as PE
from reitlens.operators import prices as PR
from reitlens.operators import properties as PP
from reitlens.operators import scores as SC
from reitlens.operators.fetch import stored
from reitlens.plans.oracle import with_tables, xavg
from reitlens.plans.queries_market import indicators
from reitlens.plans.queries_report import RUN_TS, _inputs
from reitlens.plans.queries_text import CHECK_DAYS, RUN_DATE
from reitlens.plans.registry import query
from reitlens.session import ensure_checkpoint_dir
from reitlens.sinks import writers as W
from reitlens.sources import bind
from reitlens.sources.tables import lake_for

NEXT_DATE = RUN_DATE + dt.timedelta(days=30)
NEXT_TS = "2024-06-29 12:00:00"


def _place(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("sink_raw_filings", oracle=with_tables(f"""
SELECT reit_ticker AS ticker, form_type, filing_date, accession_number AS accession,
       'sec_filings/raw/' || reit_ticker || '/' || form_type || '/' || accession_number || '.json' AS landing_key
FROM filings
WHERE filing_date > DATE '{RUN_DATE}' - INTERVAL {CHECK_DAYS} DAY AND filing_date <= DATE '{NEXT_DATE}'
  AND form_type IN ('10-K', '10-Q', '8-K')""", "filings"))
def q_sink_raw_filings(spark, sf_dir):
    """Two runs whose days overlap, the first of them repeated: every filing is landed once."""
    f = bind.filings(lake_for(spark, sf_dir)).drop("text")
    path = _place(spark, "raw-filings")
    none = f.where("false")
    for day in (RUN_DATE, RUN_DATE, NEXT_DATE):
        W.sink_raw_filings(FI.detect_new_filings(f, none, day, CHECK_DAYS), path)
    schema = "filing_date date, accession string, landing_key string, ticker string, form_type string"
    return spark.read.schema(schema).json(path).select("ticker", "form_type", "filing_date", "accession", "landing_key")


@query("sink_raw_macro", oracle=with_tables(f"""
SELECT series_id, CAST(date AS VARCHAR) AS date, value, '{RUN_DATE}' AS run_date FROM indicator_values
UNION ALL SELECT series_id, CAST(date AS VARCHAR), value, '{NEXT_DATE}' FROM indicator_values""", "indicator_values"))
def q_sink_raw_macro(spark, sf_dir):
    """Observations per series and run date; a repeated run replaces its own folders."""
    path = _place(spark, "raw-macro")
    v = bind.market_indicator_values(lake_for(spark, sf_dir)).withColumn("date", F.col("date").cast("string"))
    for day in (RUN_DATE, NEXT_DATE, RUN_DATE):
        W.sink_raw_macro(v, path, F.lit(str(day)))
    return spark.read.schema("date string, value double, series_id string, run_date string").json(path).select("series_id", "date", "value", "run_date")


@query("sink_raw_prices", oracle=with_tables(f"""
SELECT ticker, CAST(date AS VARCHAR) AS date, open, high, low, close, volume, '{RUN_DATE}' AS run_date
FROM hist100f""", "hist100f"))
def q_sink_raw_prices(spark, sf_dir):
    """The compact feed (newest 100 bars) per ticker and run date, landed twice."""
    path = _place(spark, "raw-prices")
    bars = stored(PR.compact_feed(bind.price_data(lake_for(spark, sf_dir))).withColumn("date", F.col("date").cast("string")), "compact-feed")
    for _ in range(2):
        W.sink_raw_prices(bars, path, F.lit(str(RUN_DATE)))
    schema = "date string, open double, high double, low double, close double, volume long, ticker string, run_date string"
    return spark.read.schema(schema).json(path).select("ticker", "date", "open", "high", "low", "close", "volume", "run_date")


@query("sink_benchmarks", oracle=with_tables(f"""
SELECT b.*, t.ts AS computed_at, CAST(t.ts AS DATE) AS computed_date FROM (
  SELECT r.sector, COUNT(*) AS reit_count,
         round({xavg('coalesce(l.ffo_per_share, 0)')}, 2) AS avg_ffo,
         round({xavg('coalesce(l.same_store_noi_growth, 0)')}, 2) AS avg_noi_growth,
         round({xavg('coalesce(l.net_debt_to_ebitda, 0)')}, 2) AS avg_leverage,
         round({xavg('coalesce(r.dividend_yield, 0)')}, 2) AS avg_yield,
         round({xavg('coalesce(l.weighted_avg_cap_rate, 0)')}, 4) AS avg_cap_rate
  FROM latest l JOIN reits r ON l.reit_ticker = r.ticker GROUP BY r.sector) b
CROSS JOIN (SELECT TIMESTAMP '{RUN_TS}' AS ts UNION ALL SELECT TIMESTAMP '{NEXT_TS}') t""", "reits", "latest"))
def q_sink_benchmarks(spark, sf_dir):
    """Benchmarks of two run times, the first written again after the second."""
    lake = lake_for(spark, sf_dir)
    path = _place(spark, "benchmarks")
    rows = PE.agg_sector_benchmarks(bind.reits(lake, listed_only=True), bind.financial_metrics(lake, reporting_only=True))
    for ts in (RUN_TS, NEXT_TS, RUN_TS):
        W.sink_benchmarks(rows, path, F.lit(ts).cast("timestamp_ntz"))
    return spark.read.parquet(path)


@query("sink_signals", oracle=with_tables(f"""
SELECT reit_ticker || '_' || strftime(t.ts, '%Y%m%d_%H%M%S') AS signal_id, reit_ticker AS ticker, t.ts AS generated_at,
       composite_score, fundamental_score, valuation_score, momentum_score, macro_score, sentiment_score, signal_rating,
       CAST(to_json(key_risks) AS VARCHAR) AS key_risks, confidence_score, CAST(t.ts AS DATE) AS generated_date
FROM report CROSS JOIN (SELECT TIMESTAMP '{RUN_TS}' AS ts UNION ALL SELECT TIMESTAMP '{NEXT_TS}') t""", "report"))
def q_sink_signals(spark, sf_dir):
    """Signals of two run times, each written twice; the report is computed once."""
    path = _place(spark, "signals")
    reits, metrics, summary, env = _inputs(spark, sf_dir)
    latest = stored(FU.latest_metric(metrics), "latest-metrics")  # the scores and the report read no other rows of them
    report = stored(SC.full_report(reits, latest, summary, env), "report")
    for ts in (RUN_TS, RUN_TS, NEXT_TS, NEXT_TS):
        W.sink_signals(SC.signals_for_sink(report, F.lit(ts).cast("timestamp_ntz")), path)
    return spark.read.parquet(path).select("signal_id", "ticker", "generated_at", "composite_score", "fundamental_score", "valuation_score", "momentum_score",
                                           "macro_score", "sentiment_score", "signal_rating", "key_risks", "confidence_score", "generated_date")


@query("sink_views", oracle=with_tables("""
SELECT 'reit_fundamentals_v' AS view_name, count(*) AS n_rows FROM reits r JOIN financial_metrics m ON m.reit_ticker = r.ticker
UNION ALL SELECT 'property_analysis_v', count(DISTINCT r.ticker) FROM reits r JOIN properties p ON p.reit_ticker = r.ticker WHERE p.status = 'Operating'
UNION ALL SELECT 'market_correlation_v', count(*) FROM price_data p JOIN reits r ON p.ticker = r.ticker""", "reits", "financial_metrics", "properties", "price_data"))
def q_sink_views(spark, sf_dir):
    """The three analysis views, stored, replaced once, and read by another session through the catalog."""
    lake = lake_for(spark, sf_dir)
    reits, prices = bind.reits(lake, listed_only=True), bind.price_data(lake)
    rates = AS.asof_rates(prices, bind.market_indicator_values(lake))
    views = {"reit_fundamentals_v": FU.reit_fundamentals(reits, bind.financial_metrics(lake, reporting_only=True)), "property_analysis_v": PP.property_analysis(reits, bind.properties(lake)),
             "market_correlation_v": PR.market_correlation(prices, reits, rates)}
    views = {name: stored(df, name) for name, df in views.items()}  # computed once for both versions
    root = _place(spark, "views")
    W.sink_views(spark, {name: df.limit(1) for name, df in views.items()}, root)
    W.sink_views(spark, views, root)
    other = spark.newSession()
    counts = [spark.createDataFrame([(name, other.table(f"default.{name}").count())], "view_name string, n_rows long") for name in views]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("ser_records", oracle=with_tables(f"""
SELECT replace(replace(reit_ticker || '_' || form_type || '_' || CAST(filing_date AS VARCHAR), '-', ''), ' ', '_') AS filing_id,
       reit_ticker, cik, form_type, filing_date, substr(text, 1, 500) AS extracted_text,
       CASE WHEN doc_id % 31 = 30 THEN 'Lost' ELSE 'Extracted' END AS status, TIMESTAMP '{RUN_TS}' AS created_at,
       CASE WHEN doc_id % 31 = 30 THEN '["''Lost'' is not a valid status"]' ELSE '[]' END AS dq_errors
FROM filings""", "filings"))
def q_ser_records(spark, sf_dir):
    """Filings to records (text cut, times as text) and back, unknown keys dropped, unknown states tagged."""
    from reitlens.functions import scalars as S

    f = bind.filings(lake_for(spark, sf_dir))
    rows = f.select(S.filing_id("reit_ticker", "form_type", "filing_date").alias("filing_id"), "reit_ticker", "cik", "form_type", "filing_date",
                    F.col("text").alias("extracted_text"), F.when(F.col("doc_id") % 31 == 30, "Lost").otherwise("Extracted").alias("status"),
                    F.lit(RUN_TS).cast("timestamp_ntz").alias("created_at"), F.lit("x").alias("unknown_key"))
    back = W.from_records(W.filing_records(rows), schemas.SEC_FILINGS, {"status": K.FILING_STATUSES})
    return back.select("filing_id", "reit_ticker", "cik", "form_type", "filing_date", "extracted_text", "status", "created_at", F.to_json("dq_errors").alias("dq_errors"))
