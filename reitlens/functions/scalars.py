"""Column -> Column helpers: JVM-side expressions only, no UDFs.

Each function returns an expression that Catalyst can fold into whole-stage
codegen.  Where the application has two variants of a rule (the SQL views vs
the in-memory model), both are exposed and the SQL one is the default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reitlens import constants as K

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ----------------------------------------------------------------------------
# identifiers and text
# ----------------------------------------------------------------------------

def norm_ticker(c: ColumnOrName) -> Column:
    """Strip Unicode whitespace at both ends, then upper-case."""
    return F.upper(F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", ""))


def indicator_id(series_id: ColumnOrName, date: ColumnOrName) -> Column:
    """``SERIES_YYYYMMDD``: series and ISO date joined by ``_``, dashes removed."""
    return F.regexp_replace(F.concat_ws("_", _c(series_id), _c(date).cast("string")), "-", "")


def filing_id(ticker: ColumnOrName, form: ColumnOrName, date: ColumnOrName) -> Column:
    """``TICKER_FORM_DATE`` with dashes removed and spaces turned into ``_``."""
    raw = F.concat_ws("_", _c(ticker), _c(form), _c(date).cast("string"))
    return F.replace(F.replace(raw, F.lit("-"), F.lit("")), F.lit(" "), F.lit("_"))


def signal_id(ticker: ColumnOrName, generated_at: ColumnOrName) -> Column:
    """``TICKER_yyyyMMdd_HHmmss``; ``signal_…`` when the ticker is empty."""
    ts = F.date_format(_c(generated_at), "yyyyMMdd_HHmmss")
    t = _c(ticker)
    return F.when(F.coalesce(t, F.lit("")) == "", F.concat(F.lit("signal_"), ts)).otherwise(
        F.concat(t, F.lit("_"), ts))


def zero_pad(c: ColumnOrName, width: int = 10) -> Column:
    """Left-pad with zeros to ``width``; longer input is kept whole (no truncation)."""
    s = _c(c).cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def accession_clean(c: ColumnOrName) -> Column:
    return F.replace(_c(c), F.lit("-"), F.lit(""))


def document_url(cik: ColumnOrName, accession: ColumnOrName, doc: ColumnOrName) -> Column:
    return F.concat(F.lit(K.FILING_DATA_URL), F.lit("/Archives/edgar/data/"), zero_pad(cik), F.lit("/"),
                    accession_clean(accession), F.lit("/"), _c(doc))


def excerpt(c: ColumnOrName, n: int) -> Column:
    """First ``n`` characters (characters, not bytes)."""
    return F.substring(_c(c), 1, n)


def metric_lookup(metrics: ColumnOrName, key: str, default: float | None = None) -> Column:
    """Value of ``key`` in a metrics map as double, ``default`` when absent or unparsable."""
    v = F.try_element_at(_c(metrics), F.lit(key)).cast("string")
    return F.coalesce(v.try_cast("double"), F.lit(default).cast("double"))


# ----------------------------------------------------------------------------
# fundamentals
# ----------------------------------------------------------------------------

def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0.

    Guards like ``when(b > 0, a / b)`` are not enough under ANSI mode: common
    subexpression elimination may evaluate a shared ``a / b`` before the guard.
    """
    return F.try_divide(a, b)


def payout_ratio_sql(dividend: ColumnOrName, base: ColumnOrName) -> Column:
    """View rule: dividend / base rounded to 4, NULL unless base > 0."""
    b = _c(base)
    return F.when(b > 0, F.round(safe_div(_c(dividend), b), 4))


def payout_ratio_model(dividend: ColumnOrName, base: ColumnOrName) -> Column:
    """Model rule: dividend / base unrounded, 0.0 unless base > 0 (NULLs read as 0.0)."""
    b = F.coalesce(_c(base), F.lit(0.0))
    return F.when(b > 0, safe_div(F.coalesce(_c(dividend), F.lit(0.0)), b)).otherwise(F.lit(0.0))


# ---------------------------------------------------------------------------
# FIXED VALUES — thresholds and labels of the leverage and safety bands
# ---------------------------------------------------------------------------

def leverage_rating(debt_to_ebitda: ColumnOrName) -> Column:
    """<=3 A, <=5 B, <=7 C, else D (NULL falls through to D)."""
    d = _c(debt_to_ebitda)
    return F.when(d <= 3.0, "A").when(d <= 5.0, "B").when(d <= 7.0, "C").otherwise("D")


def safety_band(payout: Column, guard: Column | None = None) -> Column:
    """Very Safe / Safe / Moderate / Risky / Unsafe over a payout ratio."""
    g = guard if guard is not None else F.lit(True)
    return (F.when(g & (payout <= 0.60), "Very Safe")
            .when(g & (payout <= 0.75), "Safe")
            .when(g & (payout <= 0.85), "Moderate")
            .when(g & (payout <= 0.95), "Risky")
            .otherwise("Unsafe"))


def dividend_safety_sql(dividend: ColumnOrName, affo: ColumnOrName) -> Column:
    """View rule: AFFO <= 0 (or NULL) is Unsafe."""
    a = _c(affo)
    return safety_band(safe_div(_c(dividend), a), a > 0)


def dividend_safety_model(dividend: ColumnOrName, affo: ColumnOrName) -> Column:
    """Model rule: the payout is 0.0 when AFFO <= 0, hence Very Safe."""
    return safety_band(payout_ratio_model(dividend, affo))


def growth_spread(ffo_growth: ColumnOrName, dividend_growth: ColumnOrName) -> Column:
    return F.coalesce(_c(ffo_growth), F.lit(0.0)) - F.coalesce(_c(dividend_growth), F.lit(0.0))


def annual_dividend(ffo: ColumnOrName, payout: ColumnOrName) -> Column:
    f = _c(ffo)
    return F.when(f > 0, f * _c(payout)).otherwise(F.lit(0.0))


def ffo_yield_master(market_cap: ColumnOrName, ffo: ColumnOrName, payout: ColumnOrName) -> Column:
    """FFO / (cap / shares) with shares = cap / FFO × payout; 0.0 when not positive.

    The operation order is kept so that results equal the model's float values.
    """
    cap, f = _c(market_cap), _c(ffo)
    shares = safe_div(cap, f) * _c(payout)
    return (F.when((cap <= 0) | (f <= 0), F.lit(0.0))
            .when(shares <= 0, F.lit(0.0))
            .otherwise(safe_div(f, safe_div(cap, shares))))


# ----------------------------------------------------------------------------
# properties
# ----------------------------------------------------------------------------

def annual_rent(sqft: ColumnOrName, rent_psf: ColumnOrName) -> Column:
    return _c(sqft) * _c(rent_psf)


#: FIXED VALUE — share of the rent that operating expenses take.
EXPENSE_RATIO = 0.35


def noi_estimate(sqft: ColumnOrName, rent_psf: ColumnOrName, occupancy: ColumnOrName) -> Column:
    return annual_rent(sqft, rent_psf) * _c(occupancy) * (F.lit(1.0) - F.lit(EXPENSE_RATIO))


def value_at_cap(noi: Column, cap_rate: ColumnOrName) -> Column:
    c = _c(cap_rate)
    return F.when(c > 0, safe_div(noi, c)).otherwise(F.lit(0.0))


def appreciation(cost: ColumnOrName, book: ColumnOrName) -> Column:
    c = _c(cost)
    return F.when(c > 0, safe_div(_c(book) - c, c)).otherwise(F.lit(0.0))


# ----------------------------------------------------------------------------
# bands over the composite score: FIXED VALUES — thresholds and labels
# ----------------------------------------------------------------------------

def signal_rating(score: ColumnOrName) -> Column:
    s = _c(score)
    return (F.when(s >= 80, "Strong Buy").when(s >= 65, "Buy").when(s >= 35, "Hold")
            .when(s >= 20, "Sell").otherwise("Strong Sell"))


def sentiment_label(score: ColumnOrName) -> Column:
    s = _c(score)
    return (F.when(s >= 85, "Very Bullish").when(s >= 65, "Bullish").when(s >= 40, "Neutral")
            .when(s >= 20, "Bearish").otherwise("Very Bearish"))


def clamp_score(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
