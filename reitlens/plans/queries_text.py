"""Registered filing, text-extraction and landed-payload queries with DuckDB oracles."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from reitlens.operators import filings as FI
from reitlens.operators.fetch import late_fetch
from reitlens.plans.oracle import register, with_tables
from reitlens.plans.registry import query
from reitlens.session import ensure_checkpoint_dir
from reitlens.sources import bind, dims, landed
from reitlens.sources import filing_files as FT
from reitlens.sources.tables import lake_for

# ---------------------------------------------------------------------------
# DuckDB twin of sources.bind.filings
# ---------------------------------------------------------------------------


def _num(whole: str, cents: str) -> str:
    return f"(CAST({whole} AS VARCHAR) || '.' || lpad(CAST({cents} AS VARCHAR), 2, '0'))"


_K = "doc_id"
_FFO = _num(f"{_K} % 9 + 1", f"{_K} % 100")
_NOI = _num(f"{_K} % 700 + 50", f"({_K} * 7) % 100")
_NOIC = f"(CAST({_K} % 9 + 1 AS VARCHAR) || ',' || lpad(CAST({_K} % 1000 AS VARCHAR), 3, '0'))"
_REV = _num(f"{_K} % 5 + 1", f"({_K} * 3) % 100")
_OCC = _num(f"{_K} % 15 + 85", f"({_K} * 11) % 100")
_DIV = _num(f"{_K} % 3", f"({_K} * 13) % 100")
_LEV = _num(f"{_K} % 8 + 2", f"({_K} * 17) % 100")
_T0 = (f"'FFO per share was $' || {_FFO} || '. Same-store NOI of $' || {_NOI} || ' million. Total revenue of $' "
       f"|| {_REV} || ' billion. Occupancy rate of ' || {_OCC} || '%. Dividend per share of $' || {_DIV} "
       f"|| '. Net debt to EBITDA of ' || {_LEV} || 'x.'")
_T1 = (f"'Funds from operations per share reached $' || {_FFO} || ' this year; net operating income was $' "
       f"|| {_NOIC} || ' thousand. Revenue was ' || {_REV} || '. Leased rate of ' || {_OCC} "
       f"|| ' %. Per share quarterly dividend paid: $' || {_DIV} || '. Debt to EBITDA stood near ' || {_LEV} || 'x'")
_T3 = (f"'ffo of $' || {_FFO} || ' per share. NOI: ' || {_NOI} || ' billion.' || chr(13) || chr(10) "
       f"|| 'Total' || chr(160) || 'revenue of $' || {_NOIC} || ' million. Occupancy: ' || {_OCC} || ' %. Dividend = $' "
       f"|| {_DIV} || '. Debt to EBITDA ratio ' || {_LEV}")

FILINGS_SQL = f"""
filings AS (
  SELECT doc_id, reit_ticker, cik, form_type, filing_date,
         lpad(cik, 10, '0') || '-' || substr(CAST(year(filing_date) AS VARCHAR), 3, 2) || '-'
           || CASE WHEN length(CAST(doc_id AS VARCHAR)) < 6 THEN lpad(CAST(doc_id AS VARCHAR), 6, '0')
                   ELSE CAST(doc_id AS VARCHAR) END AS accession_number,
         'doc' || CAST(doc_id AS VARCHAR) || '.htm' AS primary_document,
         CASE WHEN doc_id % 10 = 9 THEN CASE WHEN (doc_id // 100) % 2 <> 0 THEN '' END
              WHEN sentence IS NULL THEN text
              WHEN doc_id % 2 = 0 THEN text || chr(10) || sentence
              ELSE sentence || chr(10) || text END AS text
  FROM (
    SELECT doc_id, text,
           'R' || CAST(doc_id // 16 AS VARCHAR) AS reit_ticker,
           CAST(1000000 + (doc_id // 16) * 7 AS VARCHAR) AS cik,
           CASE WHEN doc_id % 7 = 6 THEN 'DEF 14A' WHEN doc_id % 3 = 0 THEN '10-K'
                WHEN doc_id % 3 = 1 THEN '10-Q' ELSE '8-K' END AS form_type,
           DATE '2020-01-01' + CAST((doc_id * 37) % 2190 AS INTEGER) AS filing_date,
           CASE doc_id % 4 WHEN 0 THEN {_T0} WHEN 1 THEN {_T1} WHEN 3 THEN {_T3} END AS sentence
    FROM documents)
)"""
register("filings", FILINGS_SQL)

# Java's Unicode White_Space, which ``\\s`` means under (?U); RE2's ``\\s`` is ASCII only.
_WS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _re2(pattern: str) -> str:
    return "(?i)" + pattern.replace(r"\s", _WS)


# ---------------------------------------------------------------------------
# FIXED VALUES — extraction patterns per metric in trial order, spelled out here
# so that the SQL does not follow a change of the engine's own list
# ---------------------------------------------------------------------------
SQL_PATTERNS = {
    "ffo_per_share": (
        r"FFO\s+(?:per\s+share|/share)?\s*(?:was|of)?\s*\$?([\d,.]+)",
        r"funds?\s+from\s+operations.*?per\s+share.*?\$?([\d,.]+)",
        r"FFO.*?\$([\d,.]+)\s*(?:per|/) share",
    ),
    "noi": (
        r"NOI\s*(?:was|of|:)?\s*\$?([\d,.]+)\s*(?:million|billion)",
        r"net\s+operating\s+income.*?\$?([\d,.]+)",
    ),
    "total_revenue": (
        r"total\s+revenue.*?\$?([\d,.]+)\s*(?:million|billion)",
        r"revenue\s*(?:was|of)?\s*\$?([\d,.]+)",
    ),
    "occupancy_rate": (
        r"occupancy\s*(?:rate)?\s*(?:of|was|:)?\s*([\d.]+)\s*%",
        r"leased\s*(?:percentage|rate)?\s*(?:of)?\s*([\d.]+)\s*%",
    ),
    "dividend_per_share": (
        r"dividend\s*(?:per\s+share)?\s*(?:of|was|:|=\s*)\s*\$?([\d,.]+)",
        r"per\s+share.*?dividend.*?\$([\d,.]+)",
    ),
    "debt_to_ebitda": (
        r"(?:net\s+)?debt\s*(?:to)?\s*EBITDA\s*(?:of|was|:|ratio)?\s*([\d.]+)",
        r"debt.*?EBITDA.*?([\d.]+)x",
    ),
}
METRIC_NAMES = tuple(SQL_PATTERNS)


def _captured(key: str, pattern: str, text: str) -> str:
    """SQL for the number that one pattern captures in a text, or NULL."""
    quoted = _re2(pattern).replace("'", "''")
    number = f"TRY_CAST(replace(regexp_extract({text}, '{quoted}', 1), ',', '') AS DOUBLE)"
    if key == "occupancy_rate":
        return f"{number} / 100.0"
    if key in ("noi", "total_revenue"):
        return f"{number} * CASE WHEN lower(regexp_extract({text}, '{quoted}', 0)) LIKE '%billion%' THEN 1000.0 ELSE 1.0 END"
    return number


def _metric_sql(key: str, text: str = "text") -> str:
    """SQL for a metric: the first pattern whose capture is a number."""
    return "coalesce(" + ", ".join(_captured(key, p, text) for p in SQL_PATTERNS[key]) + ")"


@query("extract_financials", headline=True, oracle=with_tables(
    f"SELECT doc_id, {', '.join(f'{_metric_sql(k)} AS {k}' for k in METRIC_NAMES)} FROM filings",
    "filings"))
def q_extract_financials(spark, sf_dir):
    return FI.extract_filing_metrics(bind.filings(lake_for(spark, sf_dir)))


RUN_TS = "2024-06-28 12:00:00"


@query("ingest_filings", oracle=with_tables(f"""
SELECT replace(replace(reit_ticker || '_' || form_type || '_' || CAST(filing_date AS VARCHAR), '-', ''), ' ', '_') AS filing_id,
       upper(trim(reit_ticker)) AS reit_ticker, cik, form_type, filing_date, CAST(NULL AS DATE) AS period_ending,
       CASE WHEN got THEN 'https://data.sec.gov/Archives/edgar/data/' || lpad(cik, 10, '0') || '/' || replace(accession_number, '-', '')
         || '/' || primary_document ELSE '' END AS document_url,
       CASE WHEN got THEN substr(text, 1, 8000) ELSE '' END AS extracted_text,
       {', '.join(f'CASE WHEN got THEN {_metric_sql(k)} END AS {k}' for k in METRIC_NAMES)},
       CASE WHEN got THEN 'Parsed' ELSE 'Failed' END AS status,
       CASE WHEN got THEN '' ELSE 'Failed to download filing document' END AS error_message,
       CASE WHEN got THEN CAST(length(text) AS BIGINT) ELSE 0 END AS file_size_bytes,
       CASE WHEN got THEN TIMESTAMP '{RUN_TS}' END AS processed_at
FROM (SELECT *, coalesce(text, '') <> '' AS got,
             row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession_number DESC) AS rn
      FROM filings)
WHERE rn = 1 AND form_type = '10-K'""", "filings"))
def q_ingest_filings(spark, sf_dir):
    out = FI.ingest_filings(bind.filings(lake_for(spark, sf_dir)), "10-K", F.lit(RUN_TS).cast("timestamp_ntz"))
    m = F.col("key_metrics_extracted")
    return out.select(*[c for c in out.columns if c != "key_metrics_extracted"],
                      *[F.try_element_at(m, F.lit(k)).alias(k) for k in METRIC_NAMES])


register("ingested", f"""
ingested AS (
SELECT replace(replace(reit_ticker || '_' || form_type || '_' || CAST(filing_date AS VARCHAR), '-', ''), ' ', '_') AS filing_id,
       {', '.join(f'{_metric_sql(k)} AS {k}' for k in METRIC_NAMES)}
FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession_number DESC) AS rn
      FROM filings)
WHERE rn = 1 AND form_type = '10-K')""", ("filings",))

RUN_DATE = dt.date(2024, 2, 19)


CHECK_DAYS = 60


def landed_before(filings):
    """Filings that an earlier run landed: older ones, and those of every second document of the days looked back."""
    return filings.where((F.col("filing_date") <= F.lit(RUN_DATE - dt.timedelta(days=CHECK_DAYS))) | (F.col("doc_id") % 2 == 0))


@query("detect_new_filings", oracle=with_tables(f"""
SELECT reit_ticker AS ticker, form_type, filing_date, accession_number AS accession,
       'sec_filings/raw/' || reit_ticker || '/' || form_type || '/' || accession_number || '.json' AS landing_key
FROM filings
WHERE filing_date > DATE '{RUN_DATE}' - INTERVAL {CHECK_DAYS} DAY AND filing_date <= DATE '{RUN_DATE}'
  AND form_type IN ('10-K', '10-Q', '8-K') AND doc_id % 2 = 1""", "filings"))
def q_detect_new_filings(spark, sf_dir):
    f = bind.filings(lake_for(spark, sf_dir)).drop("text")
    return FI.detect_new_filings(f, landed_before(f), RUN_DATE, CHECK_DAYS)


@query("scan_filing_text", oracle=with_tables("""
SELECT lpad(cik, 10, '0') AS cik, replace(accession_number, '-', '') AS accession, primary_document AS document,
       reit_ticker, form_type, filing_date, CAST(length(text) AS BIGINT) AS text_chars, sha256(text) AS text_sha256
FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession_number DESC) AS rn FROM filings)
WHERE rn = 1 AND form_type = '10-K' AND coalesce(text, '') <> ''""", "filings"))
def q_scan_filing_text(spark, sf_dir):
    """Every filer's newest filing is landed as a file; those of one form are read back and keyed by their path."""
    f = bind.filings(lake_for(spark, sf_dir))
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/filing-texts-{uuid.uuid4().hex}"
    newest = FI.newest_filing(f)
    FT.land_texts(late_fetch(newest, f.select("doc_id", "text"), "doc_id", [F.col("text")]), root)
    wanted = FT.keyed(newest.where(F.col("form_type") == "10-K")).select("cik", "accession", "document", "reit_ticker", "form_type", "filing_date")
    texts = FT.scan_filing_text(spark, root, wanted)
    return texts.select("cik", "accession", "document", "reit_ticker", "form_type", "filing_date",
                        F.char_length("text").cast("long").alias("text_chars"), F.sha2("text", 256).alias("text_sha256"))


# ---------------------------------------------------------------------------
# landed payload scans
# ---------------------------------------------------------------------------

@query("scan_macro_json", oracle=with_tables("""
SELECT * FROM market_indicators""",
                                             "market_indicators"))
def q_scan_macro_json(spark, sf_dir):
    lake = lake_for(spark, sf_dir)
    payloads = landed.macro_payloads(bind.market_indicator_values(lake))
    return landed.scan_macro_json(payloads, dims.series(spark))


NOTE_TICKER, NOTE_YEAR = "R7", 1996


@query("scan_price_daily", oracle=with_tables("""
SELECT ticker, date, open, high, low, close, volume FROM price_data""", "price_data"))
def q_scan_price_daily(spark, sf_dir):
    p = bind.price_data(lake_for(spark, sf_dir))
    payloads = landed.price_payloads(p, landed.DAILY_KEY, NOTE_TICKER, NOTE_YEAR)
    return landed.scan_price_json(payloads, landed.DAILY_KEY)


@query("scan_price_weekly", oracle=with_tables("""
SELECT ticker, max(date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low,
       arg_max(close, date) AS close, CAST(sum(volume) AS BIGINT) AS volume
FROM price_data GROUP BY ticker, date_trunc('week', date)""", "price_data"))
def q_scan_price_weekly(spark, sf_dir):
    p = landed.weekly_bars(bind.price_data(lake_for(spark, sf_dir)))
    return landed.scan_price_json(landed.price_payloads(p, landed.WEEKLY_KEY), landed.WEEKLY_KEY)


@query("scan_filing_list", oracle=with_tables("""
SELECT cik, pos, form, filing_date, accession_number, primary_document FROM (
  SELECT cik, CAST(row_number() OVER (PARTITION BY cik
                    ORDER BY filing_date DESC, accession_number DESC, form_type DESC, primary_document DESC) - 1
                   AS INTEGER) AS pos,
         form_type AS form, CAST(filing_date AS VARCHAR) AS filing_date, accession_number, primary_document
  FROM filings)
WHERE pos < 5 AND form = '10-K'""", "filings"))
def q_scan_filing_list(spark, sf_dir):
    f = bind.filings(lake_for(spark, sf_dir)).drop("text")
    return landed.scan_filing_list(landed.submission_payloads(f), "10-K", 5)


@query("scan_filing_hits", oracle=with_tables("""
SELECT reit_ticker, form_type, filing_date, accession_number FROM (
  SELECT *, row_number() OVER (PARTITION BY reit_ticker ORDER BY filing_date DESC, accession_number DESC) - 1 AS pos
  FROM filings WHERE filing_date BETWEEN DATE '2020-01-01' AND DATE '2025-12-31')
WHERE pos < 10""", "filings"))
def q_scan_filing_hits(spark, sf_dir):
    f = bind.filings(lake_for(spark, sf_dir)).drop("text")
    return landed.scan_filing_hits(landed.search_payloads(f))


@query("ingest_summary", oracle=with_tables(f"""
SELECT ticker, count(*) AS records, CASE WHEN ticker = '{NOTE_TICKER}' THEN 'API call frequency exceeded' END AS error,
       TIMESTAMP '{RUN_TS}' AS timestamp FROM price_data GROUP BY ticker
UNION ALL SELECT 'X' || s_suppkey, 0, 'Invalid API call', TIMESTAMP '{RUN_TS}' FROM supplier WHERE s_suppkey % 10 = 4
UNION ALL SELECT NULL, 0, 'Corrupt payload', TIMESTAMP '{RUN_TS}' FROM supplier WHERE s_suppkey % 10 = 9 HAVING count(*) > 0
UNION ALL
SELECT '__total__', count(*), NULL, TIMESTAMP '{RUN_TS}' FROM price_data""", "price_data"))
def q_ingest_summary(spark, sf_dir):
    """Records and errors per ticker (and in total) for one ingestion run: bars, a rate-limit note, error messages, cut-off payloads."""
    lake = lake_for(spark, sf_dir)
    good = landed.price_payloads(bind.price_data(lake), landed.DAILY_KEY, NOTE_TICKER, NOTE_YEAR)
    key = F.col("s_suppkey")
    symbol = F.concat(F.lit("X"), key.cast("string"))
    refused = lake.table("supplier", "s_suppkey").where(key % 10 == 4).select(F.to_json(F.struct(symbol.alias("symbol"), F.lit("Invalid API call").alias("Error Message"))).alias("json"))
    cut = lake.table("supplier", "s_suppkey").where(key % 10 == 9).select(F.concat(F.lit('{"symbol": "'), symbol).alias("json"))
    return landed.price_summary_rows(good.unionByName(refused).unionByName(cut), F.lit(RUN_TS).cast("timestamp_ntz"))
