"""Explicit schemas of the application's entities (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()
TS, DT = T.TimestampNTZType(), T.DateType()  # wall-clock timestamps, zone-free


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


REITS = _st(("ticker", S), ("name", S), ("sector", S), ("sub_sector", S), ("market_cap", D),
            ("ipo_year", I), ("property_count", I), ("total_sqft", D), ("geographic_focus", S),
            ("dividend_yield", D), ("payout_ratio", D), ("latest_ffo_per_share", D),
            ("created_at", TS), ("updated_at", TS))

PROPERTIES = _st(("property_id", S), ("reit_ticker", S), ("name", S), ("property_type", S),
                 ("status", S), ("address", S), ("city", S), ("state", S), ("msa", S),
                 ("sqft", D), ("occupancy_rate", D), ("annual_rent_psf", D),
                 ("lease_expiry_weighted_avg", D), ("cap_rate", D), ("acquisition_date", DT),
                 ("acquisition_cost", D), ("current_book_value", D), ("created_at", TS))

FINANCIAL_METRICS = _st(("reit_ticker", S), ("period", S), ("fiscal_year", I), ("quarter", I),
                        ("total_revenue", D), ("same_store_noi", D), ("same_store_noi_growth", D),
                        ("ffo_per_share", D), ("affo_per_share", D), ("ffo_growth_yoy", D),
                        ("net_debt_to_ebitda", D), ("interest_coverage", D),
                        ("weighted_avg_cap_rate", D), ("dividend_per_share", D),
                        ("dividend_growth_yoy", D), ("created_at", TS))

SEC_FILINGS = _st(("filing_id", S), ("reit_ticker", S), ("cik", S), ("form_type", S),
                  ("filing_date", DT), ("period_ending", DT), ("document_url", S),
                  ("extracted_text", S), ("key_metrics_extracted", T.MapType(S, D)),
                  ("status", S), ("error_message", S), ("file_size_bytes", L),
                  ("created_at", TS), ("processed_at", TS))

MARKET_INDICATORS = _st(("indicator_id", S), ("series_id", S), ("name", S), ("date", DT),
                        ("value", D), ("unit", S), ("frequency", S), ("source", S),
                        ("created_at", TS))

PRICE_DATA = _st(("ticker", S), ("date", DT), ("open", D), ("high", D), ("low", D),
                 ("close", D), ("volume", L))

REIT_SIGNALS = _st(("signal_id", S), ("reit_ticker", S), ("generated_at", TS),
                   ("fundamental_score", D), ("valuation_score", D), ("momentum_score", D),
                   ("macro_score", D), ("sentiment_score", D), ("composite_score", D),
                   ("signal_rating", S), ("sentiment", S), ("ai_analysis", S),
                   ("key_risks", T.ArrayType(S)), ("key_opportunities", T.ArrayType(S)),
                   ("data_sources", T.ArrayType(S)), ("confidence_score", D))

SECTOR_BENCHMARKS = _st(("sector", S), ("reit_count", L), ("avg_ffo", D), ("avg_noi_growth", D),
                        ("avg_leverage", D), ("avg_yield", D), ("avg_cap_rate", D),
                        ("computed_at", TS))

# Landed payload shapes --------------------------------------------------------

# macro observations: {"observations": [{"date": "...", "value": "..."}]}
MACRO_PAYLOAD = _st(("series_id", S),
                    ("observations", T.ArrayType(_st(("date", S), ("value", S)))))

# daily / weekly prices: {"Time Series (Daily)": {"2024-01-02": {"1. open": "..", ...}}}
PRICE_BAR = T.MapType(S, S)
PRICE_PAYLOAD = _st(("symbol", S), ("Time Series (Daily)", T.MapType(S, PRICE_BAR)),
                    ("Weekly Time Series", T.MapType(S, PRICE_BAR)),
                    ("Error Message", S), ("Note", S))

# submissions: {"cik": "...", "filings": {"recent": {"form": [...], ...}}}
RECENT_FILINGS = _st(("form", T.ArrayType(S)), ("filingDate", T.ArrayType(S)),
                     ("accessionNumber", T.ArrayType(S)), ("primaryDocument", T.ArrayType(S)))
SUBMISSIONS_PAYLOAD = _st(("cik", S), ("page", T.LongType()), ("filings", _st(("recent", RECENT_FILINGS))))

# search hits: {"hits": {"hits": [{"_source": {"form": .., "file_date": .., "accession_no": ..}}]}}
HIT_SOURCE = _st(("form", S), ("file_date", S), ("accession_no", S), ("ticker", S))
SEARCH_PAYLOAD = _st(("ticker", S), ("page", T.LongType()), ("hits", _st(("hits", T.ArrayType(_st(("_source", HIT_SOURCE)))))))
