"""Independent SQL (DuckDB dialect) for every registered query.

The oracle only sees the lake tables, so each derived entity is written here a
second time as a CTE, with the same arithmetic order as ``sources.bind``.
``with_tables(body, *names)`` prepends the CTEs a query needs, in dependency
order.
"""

from __future__ import annotations

D = "CAST({} AS DOUBLE)".format


def xavg(expr: str) -> str:
    """Exact average (decimal sum, one double division), as ``functions.aggs.exact_avg``."""
    return (f"CASE WHEN count({expr}) > 0 THEN CAST(sum(CAST({expr} AS DECIMAL(18,4))) AS DOUBLE)"
            f" / count({expr}) END")


def xsum(expr: str, over: str = "") -> str:
    """Exact sum as double; ``over`` adds a window clause (``OVER (...)``)."""
    return f"CAST(sum(CAST({expr} AS DECIMAL(18,4))) {over} AS DOUBLE)"

# Conditions that leave a tenth of the suppliers out; ``with_whole_tables`` drops them.
LISTED_ONLY = "\n  WHERE s.s_suppkey % 10 <> 4"
REPORTING_ONLY = "\n  WHERE l_suppkey % 10 <> 9"

GEOGRAPHY = """
geography AS (
  SELECT n.n_nationkey, n.n_name, r.r_name
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

REITS = f"""
reits AS (
  SELECT 'R' || CAST(s.s_suppkey AS VARCHAR) AS ticker,
         s.s_name AS name,
         CASE WHEN s.s_suppkey = 8 THEN 'Specialty'
              ELSE CASE g.r_name WHEN 'AFRICA' THEN 'Retail' WHEN 'AMERICA' THEN 'Office' WHEN 'ASIA' THEN 'Industrial'
              WHEN 'EUROPE' THEN 'Residential' WHEN 'MIDDLE EAST' THEN 'Healthcare' ELSE 'Specialty' END END AS sector,
         g.n_name AS sub_sector,
         abs(s.s_acctbal) * CAST(1e7 AS DOUBLE) AS market_cap,
         CAST(1990 + s.s_suppkey % 30 AS INTEGER) AS ipo_year,
         CAST(10 + s.s_suppkey % 90 AS INTEGER) AS property_count,
         CAST((s.s_suppkey % 50) * 1000000 AS DOUBLE) AS total_sqft,
         g.n_name AS geographic_focus,
         CAST(15 + (s.s_suppkey % 17) * 5 AS DOUBLE) / CAST(10 AS DOUBLE) AS dividend_yield,
         CAST(35 + (s.s_suppkey % 13) * 5 AS DOUBLE) / CAST(100 AS DOUBLE) AS payout_ratio,
         CAST((s.s_suppkey % 29) * 75 AS DOUBLE) / CAST(100 AS DOUBLE) AS latest_ffo_per_share
  FROM supplier s JOIN geography g ON s.s_nationkey = g.n_nationkey{LISTED_ONLY}
)"""

REITS_SIGNED = REITS.replace("reits AS (", "reits_signed AS (").replace(
    "abs(s.s_acctbal) * CAST(1e7 AS DOUBLE)", "s.s_acctbal * CAST(1e7 AS DOUBLE)")

def idiv(a: str, b: str) -> str:
    """Integer division truncating toward zero (DuckDB ``//`` on BIGINT)."""
    return f"(CAST({a} AS BIGINT) // CAST({b} AS BIGINT))"


def measure(units: str) -> str:
    return f"(CAST({units} AS DOUBLE) / CAST(10000 AS DOUBLE))"


def units(col: str) -> str:
    return f"CAST(round({col} * CAST(10000 AS DOUBLE)) AS BIGINT)"


METRICS_AGG = f"""
metrics_agg AS (
  SELECT l_suppkey AS suppkey,
         year(l_shipdate) AS ship_year,
         quarter(l_shipdate) AS quarter,
         count(*) AS n,
         CAST(sum(l_quantity) AS BIGINT) AS qty,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) * 100 AS BIGINT) AS rev_c,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST('1.00' AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(4,2)))) * 10000 AS BIGINT) AS net_u,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST('1.00' AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(4,2)))
             * (CAST('1.00' AS DECIMAL(3,2)) - CAST(l_tax AS DECIMAL(4,2)))) * 1000000 AS BIGINT) AS aff_u6,
         CAST(sum(CAST(l_discount AS DECIMAL(4,2))) * 100 AS BIGINT) AS disc_c,
         CAST(sum(CAST(l_tax AS DECIMAL(4,2))) * 100 AS BIGINT) AS tax_c,
         max(l_shipdate) AS last_ship
  FROM lineitem{REPORTING_ONLY}
  GROUP BY 1, 2, 3
)"""

_AFFO_U = idiv("aff_u6", "qty * 10000")

METRICS_BASE = f"""
metrics_base AS (
  SELECT 'R' || CAST(suppkey AS VARCHAR) AS reit_ticker,
         CAST(ship_year + 20 AS INTEGER) AS fiscal_year,
         CAST(quarter AS INTEGER) AS quarter,
         {measure(idiv('rev_c', '10'))} AS total_revenue,
         {measure(idiv('net_u', '1000'))} AS same_store_noi,
         {measure(idiv('net_u', 'qty * 100'))} AS ffo_per_share,
         {measure(_AFFO_U)} AS affo_per_share,
         {measure(idiv('qty * 2000', 'n'))} AS net_debt_to_ebitda,
         {measure(idiv('tax_c * 10000', 'n'))} AS interest_coverage,
         {measure(idiv('disc_c * 100', 'n'))} AS weighted_avg_cap_rate,
         {measure(idiv(_AFFO_U + ' * (disc_c * 4 + n * 55)', 'n * 100'))} AS dividend_per_share,
         CAST(last_ship AS TIMESTAMP) AS created_at,
         CAST(ship_year + 20 AS INTEGER) * 4 + CAST(quarter AS INTEGER) AS qidx
  FROM metrics_agg
)"""


def _yoy(col: str) -> str:
    prev = (f"max({units(col)}) OVER (PARTITION BY reit_ticker ORDER BY qidx "
            f"RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING)")
    return (f"CASE WHEN {prev} > 0 THEN {measure(idiv(f'({units(col)} - {prev}) * 1000000', prev))} END")


FINANCIAL_METRICS = f"""
financial_metrics AS (
  SELECT reit_ticker,
         CAST(fiscal_year AS VARCHAR) || 'Q' || CAST(quarter AS VARCHAR) AS period,
         fiscal_year, quarter, total_revenue, same_store_noi,
         {_yoy('same_store_noi')} AS same_store_noi_growth,
         ffo_per_share, affo_per_share,
         {_yoy('ffo_per_share')} AS ffo_growth_yoy,
         net_debt_to_ebitda, interest_coverage, weighted_avg_cap_rate, dividend_per_share,
         {_yoy('dividend_per_share')} AS dividend_growth_yoy,
         created_at
  FROM metrics_base
)"""

PROPERTIES = """
properties AS (
  SELECT 'P' || CAST(c.c_custkey AS VARCHAR) AS property_id,
         'R' || CAST(c.c_custkey // 15 AS VARCHAR) AS reit_ticker,
         c.c_name AS name,
         CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'Apartment' WHEN 'FURNITURE' THEN 'Retail'
              WHEN 'MACHINERY' THEN 'Industrial/Logistics' WHEN 'BUILDING' THEN 'Office'
              WHEN 'AUTOMOBILE' THEN 'Self Storage' ELSE 'Mixed Use' END AS property_type,
         CASE (c.c_custkey % 15 + c.c_nationkey) % 6 WHEN 4 THEN 'Development' WHEN 5 THEN 'Sold'
              ELSE 'Operating' END AS status,
         '' AS address,
         g.n_name AS city,
         g.r_name AS state,
         CASE WHEN c.c_acctbal >= 0 THEN g.n_name END AS msa,
         CAST((c.c_custkey % 97 + 3) * 1000 AS DOUBLE) AS sqft,
         CAST(70 + (c.c_custkey * 7 + c.c_nationkey) % 31 AS DOUBLE) / CAST(100 AS DOUBLE) AS occupancy_rate,
         CAST(1000 + (c.c_custkey % 41) * 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS annual_rent_psf,
         CAST(10 + (c.c_custkey % 13) * 5 AS DOUBLE) / CAST(10 AS DOUBLE) AS lease_expiry_weighted_avg,
         CAST(40 + (c.c_custkey * 3 + c.c_nationkey) % 50 AS DOUBLE) / CAST(1000 AS DOUBLE) AS cap_rate,
         DATE '2010-01-01' + CAST(c.c_custkey % 3650 AS INTEGER) AS acquisition_date,
         CAST((c.c_custkey % 97 + 3) * 1000 AS DOUBLE) * CAST(150 AS DOUBLE) AS acquisition_cost,
         CAST((c.c_custkey % 97 + 3) * 1000 AS DOUBLE) * CAST(120 + c.c_custkey % 60 AS DOUBLE) AS current_book_value
  FROM customer c JOIN geography g ON c.c_nationkey = g.n_nationkey
)"""

PRICE_DATA = """
price_data AS (
  SELECT ticker, date,
         CAST(first % 1000000000000 AS DOUBLE) / CAST(100 AS DOUBLE) / CAST(1000 AS DOUBLE) AS open,
         hi / CAST(1000 AS DOUBLE) AS high,
         lo / CAST(1000 AS DOUBLE) AS low,
         (CAST(CAST(px_c AS BIGINT) // CAST(volume * 10 AS BIGINT) AS DOUBLE) / CAST(10000 AS DOUBLE)) AS close,
         CAST(volume AS BIGINT) AS volume
  FROM (
    SELECT 'R' || CAST(l_suppkey AS VARCHAR) AS ticker,
           CAST(l_shipdate AS DATE) AS date,
           min(CAST(l_orderkey AS HUGEINT) * 1000000000000 + CAST(round(l_extendedprice * 100) AS HUGEINT)) AS first,
           max(l_extendedprice) AS hi,
           min(l_extendedprice) AS lo,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) * 100 AS BIGINT) AS px_c,
           count(*) AS volume
    FROM lineitem GROUP BY 1, 2
  )
)"""

INDICATOR_VALUES = f"""
indicator_values AS (
  SELECT CASE ln WHEN 1 THEN 'FEDFUNDS' WHEN 2 THEN 'DGS10' WHEN 3 THEN 'DGS2' WHEN 4 THEN 'WFII'
                 WHEN 5 THEN 'UNRATE' WHEN 6 THEN 'CPIAUCSL' WHEN 7 THEN 'HOUST' END AS series_id,
         date,
         {measure("""CASE ln WHEN 1 THEN disc_c * 10000 // n
                 WHEN 2 THEN tax_c * 10000 // n + 10000
                 WHEN 3 THEN disc_c * 10000 // n - 5000
                 WHEN 4 THEN tax_c * 10000 // n + 30000
                 WHEN 5 THEN qty * 2000 // n
                 WHEN 6 THEN qty * 100000 // n
                 ELSE qty * 500000 // n END""")} AS value
  FROM (
    SELECT ((l_linenumber - 1) % 7 + 7) % 7 + 1 AS ln, last_day(l_shipdate) AS date, CAST(count(*) AS BIGINT) AS n,
           CAST(sum(l_quantity) AS BIGINT) AS qty,
           CAST(sum(CAST(l_discount AS DECIMAL(4,2))) * 100 AS BIGINT) AS disc_c,
           CAST(sum(CAST(l_tax AS DECIMAL(4,2))) * 100 AS BIGINT) AS tax_c
    FROM lineitem GROUP BY 1, 2
  )
)"""

CTES = {
    "geography": (GEOGRAPHY, ()),
    "reits": (REITS, ("geography",)),
    "reits_signed": (REITS_SIGNED, ("geography",)),
    "metrics_agg": (METRICS_AGG, ()),
    "metrics_base": (METRICS_BASE, ("metrics_agg",)),
    "financial_metrics": (FINANCIAL_METRICS, ("metrics_base",)),
    "properties": (PROPERTIES, ("geography",)),
    "price_data": (PRICE_DATA, ()),
    "indicator_values": (INDICATOR_VALUES, ()),
}


def register(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    """Add a CTE (used by operator modules that define further derived inputs)."""
    CTES[name] = (sql, deps)


def with_tables(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body.strip()
    return "WITH " + ",".join(CTES[n][0] for n in order) + "\n" + body.strip()


def with_whole_tables(body: str, *names: str) -> str:
    """``with_tables`` with a master row and metrics for every supplier."""
    return with_tables(body, *names).replace(LISTED_ONLY, "").replace(REPORTING_ONLY, "")


def rdiv(a: str, b: str) -> str:
    """a / b rounded half away from zero to a whole number (exact); NULL when b = 0."""
    return (f"(CASE WHEN ({b}) = 0 THEN NULL ELSE sign({a}) * sign({b}) * "
            f"((2 * abs({a}) + abs({b})) // (2 * abs({b}))) END)")


def rratio(num: str, den: str, scale: int) -> str:
    """(num / den) rounded half-up to ``scale`` decimals, as double."""
    return f"(CAST({rdiv(f'({num}) * {10 ** scale}', den)} AS DOUBLE) / CAST({10 ** scale} AS DOUBLE))"


def measure_at(u: str, scale: int) -> str:
    return f"(CAST({u} AS DOUBLE) / CAST({10 ** scale} AS DOUBLE))"


SERIES_META = """
series_meta AS (
  SELECT * FROM (VALUES
    ('FEDFUNDS', 'Federal Funds Effective Rate', 'Monthly', 'Percent'),
    ('WFII', '30-Year Fixed Rate Mortgage Average', 'Weekly', 'Percent'),
    ('CPIAUCSL', 'Consumer Price Index (Urban)', 'Monthly', 'Index'),
    ('USSTHPI', 'U.S. National Home Price Index', 'Quarterly', 'Index'),
    ('UNRATE', 'Unemployment Rate', 'Monthly', 'Percent'),
    ('TTLCONS', 'Total Construction Spending', 'Monthly', 'Billions USD'),
    ('PERMIT', 'New Private Housing Building Permits', 'Monthly', 'Thousands'),
    ('DGS10', '10-Year Treasury Constant Maturity Rate', 'Daily', 'Percent'),
    ('DGS2', '2-Year Treasury Constant Maturity Rate', 'Daily', 'Percent'),
    ('MSPUS', 'Median Sales Price of Houses Sold', 'Monthly', 'USD'),
    ('HOUST', 'New Privately-Owned Housing Units Started', 'Monthly', 'Thousands')
  ) AS t(series_id, name, frequency, unit)
)"""

MARKET_INDICATORS = """
market_indicators AS (
  SELECT replace(concat_ws('_', v.series_id, CAST(v.date AS VARCHAR)), '-', '') AS indicator_id,
         v.series_id, coalesce(m.name, v.series_id) AS name, v.date, v.value,
         coalesce(m.unit, '') AS unit, coalesce(m.frequency, '') AS frequency, 'FRED' AS source
  FROM indicator_values v LEFT JOIN series_meta m ON v.series_id = m.series_id
)"""

NUMBERED = """
numbered AS (
  SELECT series_id, date, value,
         row_number() OVER (PARTITION BY series_id ORDER BY date DESC, value DESC) AS rn
  FROM indicator_values WHERE value IS NOT NULL
)"""

HIST = f"""
hist AS (
  SELECT ticker, date, close, volume, {units('close')} AS cu,
         row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn
  FROM price_data
)"""

CTES.update({
    "series_meta": (SERIES_META, ()),
    "market_indicators": (MARKET_INDICATORS, ("indicator_values", "series_meta")),
    "numbered": (NUMBERED, ("indicator_values",)),
    "hist": (HIST, ("price_data",)),
})
