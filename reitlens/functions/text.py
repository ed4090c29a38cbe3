"""Text functions: number formatting and financial-figure extraction from filings.

Extraction is plain JVM regex (``regexp_extract``) over the whole text, so it
runs inside whole-stage codegen with no Python in the hot path.  For each
metric the patterns are tried in order and the first one whose capture parses
as a number wins; a capture that does not parse (``"4.05."``, ``","``) falls
through to the next pattern, exactly as the application does.

The patterns run with ``(?idU)``: case-insensitive, ``.`` stops only at
``\\n`` (UNIX lines) and Unicode character classes, which together agree with
CPython's ``re.IGNORECASE`` on ``\\s``, ``\\d`` and ``.``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPARK_FLAGS = "(?idU)"

# ---------------------------------------------------------------------------
# FIXED VALUES — extraction patterns, per metric, in trial order
# ---------------------------------------------------------------------------
FFO_PATTERNS = (
    r"FFO\s+(?:per\s+share|/share)?\s*(?:was|of)?\s*\$?([\d,.]+)",
    r"funds?\s+from\s+operations.*?per\s+share.*?\$?([\d,.]+)",
    r"FFO.*?\$([\d,.]+)\s*(?:per|/) share",
)
NOI_PATTERNS = (
    r"NOI\s*(?:was|of|:)?\s*\$?([\d,.]+)\s*(?:million|billion)",
    r"net\s+operating\s+income.*?\$?([\d,.]+)",
)
REVENUE_PATTERNS = (
    r"total\s+revenue.*?\$?([\d,.]+)\s*(?:million|billion)",
    r"revenue\s*(?:was|of)?\s*\$?([\d,.]+)",
)
OCCUPANCY_PATTERNS = (
    r"occupancy\s*(?:rate)?\s*(?:of|was|:)?\s*([\d.]+)\s*%",
    r"leased\s*(?:percentage|rate)?\s*(?:of)?\s*([\d.]+)\s*%",
)
DIVIDEND_PATTERNS = (
    r"dividend\s*(?:per\s+share)?\s*(?:of|was|:|=\s*)\s*\$?([\d,.]+)",
    r"per\s+share.*?dividend.*?\$([\d,.]+)",
)
DEBT_PATTERNS = (
    r"(?:net\s+)?debt\s*(?:to)?\s*EBITDA\s*(?:of|was|:|ratio)?\s*([\d.]+)",
    r"debt.*?EBITDA.*?([\d.]+)x",
)

# Keyword guards: every pattern of a metric contains one of these literals, so
# a text the guard does not match cannot match any of the metric's patterns.
# Checking the guard first skips the expensive ``.*?`` scans on most texts.
GUARDS = {
    "ffo_per_share": r"FFO|funds?\s+from",
    "noi": r"NOI|net\s+operating",
    "total_revenue": r"revenue",
    "occupancy_rate": r"occupancy|leased",
    "dividend_per_share": r"dividend",
    "debt_to_ebitda": r"debt",
}

# (output key, patterns, strip commas, scale billions, divide by 100)
METRICS = (
    ("ffo_per_share", FFO_PATTERNS, True, False, False),
    ("noi", NOI_PATTERNS, True, True, False),
    ("total_revenue", REVENUE_PATTERNS, True, True, False),
    ("occupancy_rate", OCCUPANCY_PATTERNS, False, False, True),
    ("dividend_per_share", DIVIDEND_PATTERNS, True, False, False),
    ("debt_to_ebitda", DEBT_PATTERNS, False, False, False),
)
METRIC_KEYS = tuple(m[0] for m in METRICS)


def _attempt(text: Column, pattern: str, strip_commas: bool, billions: bool,
             percent: bool) -> Column:
    p = SPARK_FLAGS + pattern
    if billions:
        # one scan of the whole text for the full match; the capture is then taken
        # from that short match (same first match: the patterns use no anchors,
        # look-arounds or word boundaries, so truncating after the match changes nothing)
        whole = F.regexp_extract(text, p, 0)
        raw = F.regexp_extract(whole, p, 1)
    else:
        raw = F.regexp_extract(text, p, 1)
    if strip_commas:
        raw = F.replace(raw, F.lit(","), F.lit(""))
    val = raw.try_cast("double")
    if billions:
        val = F.when(F.contains(F.lower(whole), F.lit("billion")), val * F.lit(1000.0)).otherwise(val)
    if percent:
        val = val / F.lit(100.0)
    return val


def extract_metric(text: Column, key: str) -> Column:
    """One metric: first pattern whose capture parses, else NULL."""
    _, patterns, strip, bil, pct = next(m for m in METRICS if m[0] == key)
    found = F.coalesce(*[_attempt(text, p, strip, bil, pct) for p in patterns])
    return F.when(text.rlike(SPARK_FLAGS + GUARDS[key]), found)


def extract_financials(text: Column) -> Column:
    """``map<string,double>`` of the metrics found (absent keys are left out)."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), extract_metric(text, k).alias("value"))
                        for k in METRIC_KEYS])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def py_fixed(c: Column, digits: int) -> Column:
    """Like Python ``f"{x:.{digits}f}"``: half-even on the exact binary value, no grouping."""
    return F.regexp_replace(F.format_number(c, digits), ",", "")


def py_str(c: Column) -> Column:
    """A double of at most twelve decimals as ``str`` prints it (from 0.0001 to below 1e16), null as ``N/A``."""
    plain = F.regexp_replace(c.cast("decimal(38,12)").cast("string"), "0+$", "")
    return F.when(c.isNull(), "N/A").otherwise(F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain))


def py_percent0(c: Column) -> Column:
    """Like Python ``f"{x:.0%}"``."""
    return F.concat(py_fixed(c * F.lit(100.0), 0), F.lit("%"))


def py_round(c: Column, digits: int) -> Column:
    """Python ``round(x, digits)`` for doubles: exact binary value, ties to even."""
    return py_fixed(c, digits).cast("double")
