"""Derive the REIT-shaped tables from the landed TPC-H-style lake.

The application works on seven entities (REIT master, quarterly metrics,
properties, daily prices, macro observations, filings).  The lake holds a
star schema instead, so each entity is *derived* from it here, as one
distributed job per table:

* ``reits``            supplier ⋈ nation ⋈ region (one REIT per supplier)
* ``financial_metrics`` lineitem aggregated by (supplier, ship year, quarter)
* ``properties``       customer ⋈ nation ⋈ region (15 properties per supplier)
* ``price_data``       lineitem aggregated by (supplier, ship date)
* ``market_indicators`` lineitem aggregated by (line number, month end)
* ``filings``          documents with a templated financial sentence

One REIT stands alone in its sector, and some filing texts are missing.  The
queries whose outer joins, defaults and error outcomes need such rows take the
tables without a tenth of the suppliers (``listed_only``, ``reporting_only``).

Arithmetic is written as exact decimal sums followed by plain double
operations, so that any engine evaluating the same expression order gets the
same bits (the DuckDB oracle in ``reitlens.plans.oracle`` mirrors every line).
Derived measures are whole ten-thousandths (4 decimals, truncated by integer
division, which both engines do exactly), so later averages can be summed
exactly as decimals (``functions.aggs``).
Only nation and region are broadcast: TPC-H fixes them at 25 and 5 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reitlens.functions.exact import combine_split, intdiv, split_sum
from reitlens.sources.tables import Lake

# Customers per supplier in the TPC-H generator (150,000 vs 10,000 per scale
# factor); properties are assigned to owners in blocks of this size.
PROPERTIES_PER_REIT = 15
# Last digits of the supplier keys that ``listed_only`` and ``reporting_only`` leave out.
NO_MASTER, NO_METRICS = 4, 9
# The supplier whose REIT is alone in its sector.
LONE_REIT, LONE_SECTOR = 8, "Specialty"
# Last digit of the documents whose filing text never arrived.
NO_TEXT = 9
# Documents filed by one filer, so that filers grow with the documents.
FILINGS_PER_FILER = 16
# Years added to ship dates so that fiscal years start after 2000.
FISCAL_YEAR_SHIFT = 20

# macro series built from lineitem line numbers, taken modulo seven
SERIES_BY_LINENUMBER = ((1, "FEDFUNDS"), (2, "DGS10"), (3, "DGS2"), (4, "WFII"),
                        (5, "UNRATE"), (6, "CPIAUCSL"), (7, "HOUST"))


def ticker_of(key: Column) -> Column:
    """REIT ticker for an integer key: ``'R' || key``.

    ``concat_ws`` is never NULL, so Catalyst does not infer an ``IS NOT NULL``
    filter on the ticker and push it down as a per-row string build at the scan.
    """
    return F.concat_ws("", F.lit("R"), key.cast("string"))


def _ratio(numerator: Column, denominator: int) -> Column:
    """Exact integer numerator divided once in double precision."""
    return numerator.cast("double") / F.lit(float(denominator))


def _dec(name: str, precision: str = "12,2") -> Column:
    return F.col(name).cast(f"decimal({precision})")


def geography(lake: Lake) -> DataFrame:
    """nation ⋈ region: 25 rows by construction, safe to broadcast."""
    n = lake.table("nation", "n_nationkey", "n_name", "n_regionkey")
    r = lake.table("region", "r_regionkey", "r_name")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", "n_name", "r_name")


# region -> sector of the derived REITs (five of the eight sector values)
REGION_SECTORS = (("AFRICA", "Retail"), ("AMERICA", "Office"), ("ASIA", "Industrial"),
                  ("EUROPE", "Residential"), ("MIDDLE EAST", "Healthcare"))


def _sector_of(region: Column) -> Column:
    out = F.lit("Specialty")
    for reg, sec in reversed(REGION_SECTORS):
        out = F.when(region == reg, sec).otherwise(out)
    return out


def _reits(lake: Lake, signed_market_cap: bool = False, listed_only: bool = False) -> DataFrame:
    """One REIT per supplier; sector from the region, sub-sector = nation.

    ``signed_market_cap`` keeps the sign of ``s_acctbal`` so that the
    data-quality rules have negative market caps to quarantine.
    """
    s = lake.table("supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    key = F.col("s_suppkey")
    bal = F.col("s_acctbal") if signed_market_cap else F.abs(F.col("s_acctbal"))
    listed = s.where(key % 10 != NO_MASTER) if listed_only else s
    return listed.join(F.broadcast(geography(lake)), s.s_nationkey == F.col("n_nationkey")).select(
        ticker_of(key).alias("ticker"),
        F.col("s_name").alias("name"),
        F.when(key == LONE_REIT, LONE_SECTOR).otherwise(_sector_of(F.col("r_name"))).alias("sector"),
        F.col("n_name").alias("sub_sector"),
        (bal * F.lit(1e7)).alias("market_cap"),
        (F.lit(1990) + key % 30).cast("int").alias("ipo_year"),
        (F.lit(10) + key % 90).cast("int").alias("property_count"),
        ((key % 50) * 1000000).cast("double").alias("total_sqft"),
        F.col("n_name").alias("geographic_focus"),
        _ratio(F.lit(15) + (key % 17) * 5, 10).alias("dividend_yield"),
        _ratio(F.lit(35) + (key % 13) * 5, 100).alias("payout_ratio"),
        _ratio((key % 29) * 75, 100).alias("latest_ffo_per_share"),
    )


UNITS = 10000  # measures are stored as whole ten-thousandths (4 decimals, truncated)


def _intdiv(a: Column, b: Column) -> Column:
    """Exact long division truncating toward zero (``div``); NULL when b = 0."""
    return intdiv(a, b)


def _measure(units: Column) -> Column:
    """Whole ten-thousandths -> double (one correctly rounded division)."""
    return units.cast("double") / F.lit(float(UNITS))


def _units(c: str) -> Column:
    """A stored 4-decimal measure back to exact whole ten-thousandths."""
    return F.round(F.col(c) * F.lit(float(UNITS))).cast("long")


def _prev(col: str, window) -> Column:
    """Units of ``col`` exactly four quarters back (one window expression per measure)."""
    return F.max(_units(col)).over(window).alias(f"_prev_{col}")


def _yoy(col: str) -> Column:
    """Year-over-year growth in percent from ``_prev_<col>``."""
    prev = F.col(f"_prev_{col}")
    return F.when(prev > 0, _measure(_intdiv((_units(col) - prev) * (100 * UNITS), prev)))


def _financial_metrics(lake: Lake, reporting_only: bool = False) -> DataFrame:
    """Quarterly metrics per supplier from its line items.

    The aggregation is partial-then-final (map-side combine), so a supplier
    holding a third of all lines only shuffles one partial row per task.
    Sums are exact decimals turned into whole cents / ten-thousandths; every
    measure is an integer division of those, truncated to 4 decimals.
    Year-over-year growth reads the row exactly four quarters earlier through
    a value-range frame; the window shuffles the aggregated rows only.
    """
    li = lake.table("lineitem", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                    "l_tax", "l_shipdate")
    # exact fixed-point values per row: price in cents, rates in hundredths
    ep_c = F.round(F.col("l_extendedprice") * F.lit(100.0)).cast("long")
    disc_c = F.round(F.col("l_discount") * F.lit(100.0)).cast("long")
    tax_c = F.round(F.col("l_tax") * F.lit(100.0)).cast("long")
    net_u = ep_c * (F.lit(100) - disc_c)                     # 1e-4 units
    aff_u = net_u * (F.lit(100) - tax_c)                     # 1e-6 units
    lines = li.where(F.col("l_suppkey") % 10 != NO_METRICS) if reporting_only else li
    pre = lines.select(
        F.col("l_suppkey").alias("suppkey"),
        F.year("l_shipdate").alias("ship_year"),
        F.quarter("l_shipdate").alias("quarter"),
        F.col("l_quantity").cast("long").alias("q"),
        ep_c.alias("ep_c"), net_u.alias("net_u"), aff_u.alias("aff_u"),
        disc_c.alias("disc_c"), tax_c.alias("tax_c"), "l_shipdate")
    rev_hi, rev_lo = split_sum(F.col("ep_c"))
    net_hi, net_lo = split_sum(F.col("net_u"))
    aff_hi, aff_lo = split_sum(F.col("aff_u"))
    agg = pre.groupBy("suppkey", "ship_year", "quarter").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("q").alias("qty"),
        rev_hi.alias("rev_hi"), rev_lo.alias("rev_lo"),
        net_hi.alias("net_hi"), net_lo.alias("net_lo"),
        aff_hi.alias("aff_hi"), aff_lo.alias("aff_lo"),
        F.sum("disc_c").alias("disc_c"),
        F.sum("tax_c").alias("tax_c"),
        F.max("l_shipdate").alias("last_ship"),
    ).select("suppkey", "ship_year", "quarter", "n", "qty", "disc_c", "tax_c", "last_ship",
             combine_split(F.col("rev_hi"), F.col("rev_lo")).alias("rev_c"),
             combine_split(F.col("net_hi"), F.col("net_lo")).alias("net_u"),
             combine_split(F.col("aff_hi"), F.col("aff_lo")).alias("aff_u6"))
    n, qty = F.col("n"), F.col("qty")
    affo_u = _intdiv(F.col("aff_u6"), qty * 10000)
    base = agg.select(
        ticker_of(F.col("suppkey")).alias("reit_ticker"),
        (F.col("ship_year") + FISCAL_YEAR_SHIFT).cast("int").alias("fiscal_year"),
        F.col("quarter").cast("int").alias("quarter"),
        _measure(_intdiv(F.col("rev_c"), F.lit(10))).alias("total_revenue"),
        _measure(_intdiv(F.col("net_u"), F.lit(1000))).alias("same_store_noi"),
        _measure(_intdiv(F.col("net_u"), qty * 100)).alias("ffo_per_share"),
        _measure(affo_u).alias("affo_per_share"),
        _measure(_intdiv(qty * 2000, n)).alias("net_debt_to_ebitda"),
        _measure(_intdiv(F.col("tax_c") * 10000, n)).alias("interest_coverage"),
        _measure(_intdiv(F.col("disc_c") * 100, n)).alias("weighted_avg_cap_rate"),
        _measure(_intdiv(affo_u.cast("decimal(38,0)") * (F.col("disc_c") * 4 + n * 55), n * 100))
        .alias("dividend_per_share"),
        F.col("last_ship").cast("timestamp_ntz").alias("created_at"),
    ).withColumn("qidx", F.col("fiscal_year") * 4 + F.col("quarter"))
    w = Window.partitionBy("reit_ticker").orderBy("qidx").rangeBetween(-4, -4)
    growth = ("same_store_noi", "ffo_per_share", "dividend_per_share")
    lagged = base.select("*", *[_prev(c, w) for c in growth])
    return lagged.select(
        "reit_ticker",
        F.concat(F.col("fiscal_year").cast("string"), F.lit("Q"),
                 F.col("quarter").cast("string")).alias("period"),
        "fiscal_year", "quarter", "total_revenue", "same_store_noi",
        _yoy("same_store_noi").alias("same_store_noi_growth"),
        "ffo_per_share", "affo_per_share",
        _yoy("ffo_per_share").alias("ffo_growth_yoy"),
        "net_debt_to_ebitda", "interest_coverage", "weighted_avg_cap_rate",
        "dividend_per_share",
        _yoy("dividend_per_share").alias("dividend_growth_yoy"),
        "created_at",
    )


_SEGMENT_TO_TYPE = (("HOUSEHOLD", "Apartment"), ("FURNITURE", "Retail"),
                    ("MACHINERY", "Industrial/Logistics"), ("BUILDING", "Office"),
                    ("AUTOMOBILE", "Self Storage"))


def _properties(lake: Lake) -> DataFrame:
    """Customers become properties; every block of 15 belongs to one supplier."""
    c = lake.table("customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    key, nat = F.col("c_custkey"), F.col("c_nationkey")
    slot = (key % PROPERTIES_PER_REIT + nat) % 6
    ptype = F.lit("Mixed Use")
    for seg, typ in reversed(_SEGMENT_TO_TYPE):
        ptype = F.when(F.col("c_mktsegment") == seg, typ).otherwise(ptype)
    sqft = ((key % 97 + 3) * 1000).cast("double")
    return c.join(F.broadcast(geography(lake)), nat == F.col("n_nationkey")).select(
        F.concat(F.lit("P"), key.cast("string")).alias("property_id"),
        ticker_of(intdiv(key, F.lit(PROPERTIES_PER_REIT))).alias("reit_ticker"),
        F.col("c_name").alias("name"),
        ptype.alias("property_type"),
        F.when(slot == 4, "Development").when(slot == 5, "Sold").otherwise("Operating")
        .alias("status"),
        F.lit("").alias("address"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        F.when(F.col("c_acctbal") >= 0, F.col("n_name")).alias("msa"),
        sqft.alias("sqft"),
        _ratio(F.lit(70) + (key * 7 + nat) % 31, 100).alias("occupancy_rate"),
        _ratio(F.lit(1000) + (key % 41) * 50, 100).alias("annual_rent_psf"),
        _ratio(F.lit(10) + (key % 13) * 5, 10).alias("lease_expiry_weighted_avg"),
        _ratio(F.lit(40) + (key * 3 + nat) % 50, 1000).alias("cap_rate"),
        F.date_add(F.lit("2010-01-01").cast("date"), (key % 3650).cast("int"))
        .alias("acquisition_date"),
        (sqft * F.lit(150.0)).alias("acquisition_cost"),
        (sqft * (F.lit(120) + key % 60).cast("double")).alias("current_book_value"),
    )


def etf_prices(lake: Lake, symbols: tuple[str, ...]) -> DataFrame:
    """Daily bars of funds: fund i holds the tickers whose number leaves remainder i; the last remainder is a symbol that no list knows."""
    p = price_data(lake)
    held = F.substring("ticker", 2, 20).cast("long") % (len(symbols) + 1)
    symbol = F.element_at(F.array(*[F.lit(s) for s in (*symbols, UNKNOWN_ETF)]), (held + 1).cast("int"))
    g = p.groupBy(symbol.alias("symbol"), "date").agg(
        F.sum(F.round(F.col("close") * F.lit(float(UNITS))).cast("long")).alias("u"), F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))
    return g.select(F.col("symbol").alias("ticker"), "date", _measure(_intdiv(F.col("u"), F.col("n"))).alias("close"), "volume")


UNKNOWN_ETF = "XXRE"
CENTS_LIMIT = 10 ** 12  # prices per line stay far below ten billion


def _price_data(lake: Lake) -> DataFrame:
    """Daily OHLCV per supplier from the line items shipped that day (partial aggregation).

    The open is the lowest price of the day's smallest order: order and cents in
    one decimal key, which a hash aggregate keeps in place.
    """
    li = lake.table("lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    cents = F.round(F.col("l_extendedprice") * F.lit(100.0)).cast("long")
    first = F.col("l_orderkey").cast("decimal(20,0)") * F.lit(CENTS_LIMIT).cast("decimal(13,0)") + cents.cast("decimal(13,0)")
    g = li.groupBy(F.col("l_suppkey").alias("suppkey"), F.to_date("l_shipdate").alias("date")).agg(
        F.min(first).alias("first"),
        F.max("l_extendedprice").alias("hi"),
        F.min("l_extendedprice").alias("lo"),
        F.sum(cents).alias("px_c"),
        F.count(F.lit(1)).alias("volume"),
    )
    k = F.lit(1000.0)
    opened = (F.col("first") % F.lit(CENTS_LIMIT).cast("decimal(13,0)")).cast("double") / F.lit(100.0)
    return g.select(
        ticker_of(F.col("suppkey")).alias("ticker"), "date",
        (opened / k).alias("open"),
        (F.col("hi") / k).alias("high"),
        (F.col("lo") / k).alias("low"),
        _measure(_intdiv(F.col("px_c"), F.col("volume") * 10)).alias("close"),
        F.col("volume").cast("long").alias("volume"),
    )


def _market_indicator_values(lake: Lake) -> DataFrame:
    """(series_id, date, value) monthly observations from line items."""
    li = lake.table("lineitem", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    g = li.groupBy(
        (F.pmod(F.col("l_linenumber") - 1, F.lit(7)) + 1).alias("ln"),
        F.last_day("l_shipdate").alias("date"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l_quantity").cast("long").alias("qty"),
        (F.sum(_dec("l_discount", "4,2")) * 100).cast("long").alias("disc_c"),
        (F.sum(_dec("l_tax", "4,2")) * 100).cast("long").alias("tax_c"),
    )
    n, ln = F.col("n"), F.col("ln")
    disc_pct = _intdiv(F.col("disc_c") * UNITS, n)
    tax_pct = _intdiv(F.col("tax_c") * UNITS, n)
    qty = F.col("qty")
    units = (F.when(ln == 1, disc_pct)
             .when(ln == 2, tax_pct + UNITS)
             .when(ln == 3, disc_pct - UNITS // 2)
             .when(ln == 4, tax_pct + 3 * UNITS)
             .when(ln == 5, _intdiv(qty * (UNITS // 5), n))
             .when(ln == 6, _intdiv(qty * (UNITS * 10), n))
             .otherwise(_intdiv(qty * (UNITS * 50), n)))
    sid = F.lit(None).cast("string")
    for num, name in reversed(SERIES_BY_LINENUMBER):
        sid = F.when(ln == num, name).otherwise(sid)
    return g.select(sid.alias("series_id"), "date",
                                            _measure(units).alias("value"))


def _num_text(whole: Column, cents: Column) -> Column:
    return F.concat(whole.cast("string"), F.lit("."), F.lpad(cents.cast("string"), 2, "0"))


def filing_sentence(doc_id: Column) -> Column:
    """Templated financial sentence; a quarter of the documents get none."""
    k = doc_id
    ffo = _num_text(k % 9 + 1, k % 100)
    noi = _num_text(k % 700 + 50, (k * 7) % 100)
    noi_comma = F.concat((k % 9 + 1).cast("string"), F.lit(","),
                         F.lpad((k % 1000).cast("string"), 3, "0"))
    rev = _num_text(k % 5 + 1, (k * 3) % 100)
    occ = _num_text(k % 15 + 85, (k * 11) % 100)
    div = _num_text(k % 3, (k * 13) % 100)
    lev = _num_text(k % 8 + 2, (k * 17) % 100)
    t0 = F.concat(F.lit("FFO per share was $"), ffo, F.lit(". Same-store NOI of $"), noi,
                  F.lit(" million. Total revenue of $"), rev, F.lit(" billion. Occupancy rate of "),
                  occ, F.lit("%. Dividend per share of $"), div, F.lit(". Net debt to EBITDA of "),
                  lev, F.lit("x."))
    t1 = F.concat(F.lit("Funds from operations per share reached $"), ffo,
                  F.lit(" this year; net operating income was $"), noi_comma,
                  F.lit(" thousand. Revenue was "), rev, F.lit(". Leased rate of "), occ,
                  F.lit(" %. Per share quarterly dividend paid: $"), div,
                  F.lit(". Debt to EBITDA stood near "), lev, F.lit("x"))
    t3 = F.concat(F.lit("ffo of $"), ffo, F.lit(" per share. NOI: "), noi,
                  F.lit(" billion.\r\nTotal\u00a0revenue of $"), noi_comma,
                  F.lit(" million. Occupancy: "), occ, F.lit(" %. Dividend = $"), div,
                  F.lit(". Debt to EBITDA ratio "), lev)
    m = k % 4
    return F.when(m == 0, t0).when(m == 1, t1).when(m == 3, t3)


def _filings(lake: Lake) -> DataFrame:
    """Landed filing documents: one filing per document, text kept whole; some texts are missing (null or empty)."""
    d = lake.table("documents", "doc_id", "text")
    k = F.col("doc_id")
    form = (F.when(k % 7 == 6, "DEF 14A")
            .when(k % 3 == 0, "10-K").when(k % 3 == 1, "10-Q").otherwise("8-K"))
    filer = intdiv(k, F.lit(FILINGS_PER_FILER))
    cik = (F.lit(1000000) + filer * 7).cast("string")
    fdate = F.date_add(F.lit("2020-01-01").cast("date"), ((k * 37) % 2190).cast("int"))
    ds = k.cast("string")
    doc_num = F.when(F.length(ds) < 6, F.lpad(ds, 6, "0")).otherwise(ds)
    sentence = filing_sentence(k)
    text = (F.when(k % 10 == NO_TEXT, F.when(intdiv(k, F.lit(100)) % 2 != 0, F.lit("")))
            .when(sentence.isNull(), F.col("text"))
            .when(k % 2 == 0, F.concat(F.col("text"), F.lit("\n"), sentence))
            .otherwise(F.concat(sentence, F.lit("\n"), F.col("text"))))
    return d.select(
        k.alias("doc_id"),
        ticker_of(filer).alias("reit_ticker"),
        cik.alias("cik"),
        form.alias("form_type"),
        fdate.alias("filing_date"),
        F.concat(F.lpad(cik, 10, "0"), F.lit("-"),
                 F.substring(F.year(fdate).cast("string"), 3, 2), F.lit("-"), doc_num)
        .alias("accession_number"),
        F.concat(F.lit("doc"), ds, F.lit(".htm")).alias("primary_document"),
        text.alias("text"),
    )


# ---------------------------------------------------------------------------
# public derivations: one plan per lake handle
# ---------------------------------------------------------------------------

def reits(lake: Lake, signed_market_cap: bool = False, listed_only: bool = False) -> DataFrame:
    """A master row for every supplier; ``listed_only`` leaves a tenth of them out."""
    return lake.derived(f"reits:{signed_market_cap}:{listed_only}", lambda: _reits(lake, signed_market_cap, listed_only))


def financial_metrics(lake: Lake, reporting_only: bool = False) -> DataFrame:
    """Metrics of every supplier; ``reporting_only`` leaves a tenth of them out."""
    return lake.derived(f"financial_metrics:{reporting_only}", lambda: _financial_metrics(lake, reporting_only))


def properties(lake: Lake) -> DataFrame:
    return lake.derived("properties", lambda: _properties(lake))


def price_data(lake: Lake) -> DataFrame:
    return lake.derived("price_data", lambda: _price_data(lake))


def market_indicator_values(lake: Lake) -> DataFrame:
    return lake.derived("market_indicator_values", lambda: _market_indicator_values(lake))


def filings(lake: Lake) -> DataFrame:
    return lake.derived("filings", lambda: _filings(lake))
