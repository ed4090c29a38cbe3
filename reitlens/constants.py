"""Fixed values that results depend on.

Everything here must equal the published behaviour of the application this
engine re-implements: enum values, series metadata, seed dimensions, score
weights, band thresholds and message texts.  They are kept together, in their
natural order, as plain data.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — enums
# ---------------------------------------------------------------------------
SECTORS = ("Retail", "Office", "Industrial", "Residential", "Healthcare",
           "DataCenter", "Infrastructure", "Specialty")

PROPERTY_TYPES = ("Retail", "Office", "Industrial/Logistics", "Apartment", "Single Family",
                  "Healthcare", "Data Center", "Tower", "Self Storage", "Hospitality",
                  "Mixed Use")

PROPERTY_STATUSES = ("Operating", "Development", "Redevelopment", "Vacant", "Sold")

FORM_TYPES = ("10-K", "10-Q", "8-K", "10-K/A", "10-Q/A", "DEF 14A", "SC 13D")

FILING_STATUSES = ("Pending", "Downloaded", "Extracted", "Parsed", "Failed")

# Forms the daily filing check keeps.
WATCHED_FORMS = ("10-K", "10-Q", "8-K")

SIGNAL_RATINGS = ("Strong Buy", "Buy", "Hold", "Sell", "Strong Sell")
SENTIMENTS = ("Very Bullish", "Bullish", "Neutral", "Bearish", "Very Bearish")

# ---------------------------------------------------------------------------
# FIXED VALUES — macro series metadata (series_id, name, frequency, unit)
# ---------------------------------------------------------------------------
SERIES = (
    ("FEDFUNDS", "Federal Funds Effective Rate", "Monthly", "Percent"),
    ("WFII", "30-Year Fixed Rate Mortgage Average", "Weekly", "Percent"),
    ("CPIAUCSL", "Consumer Price Index (Urban)", "Monthly", "Index"),
    ("USSTHPI", "U.S. National Home Price Index", "Quarterly", "Index"),
    ("UNRATE", "Unemployment Rate", "Monthly", "Percent"),
    ("TTLCONS", "Total Construction Spending", "Monthly", "Billions USD"),
    ("PERMIT", "New Private Housing Building Permits", "Monthly", "Thousands"),
    ("DGS10", "10-Year Treasury Constant Maturity Rate", "Daily", "Percent"),
    ("DGS2", "2-Year Treasury Constant Maturity Rate", "Daily", "Percent"),
    ("MSPUS", "Median Sales Price of Houses Sold", "Monthly", "USD"),
    ("HOUST", "New Privately-Owned Housing Units Started", "Monthly", "Thousands"),
)

# The ten series used for REIT analysis (all but MSPUS), in this order.
RELEVANT_SERIES = ("FEDFUNDS", "WFII", "DGS10", "DGS2", "CPIAUCSL", "USSTHPI", "UNRATE",
                   "TTLCONS", "PERMIT", "HOUST")

# ---------------------------------------------------------------------------
# FIXED VALUES — REIT ETFs (symbol, name)
# ---------------------------------------------------------------------------
REIT_ETFS = (
    ("VNQ", "Vanguard Real Estate ETF"),
    ("SCHH", "Schwab U.S. REIT ETF"),
    ("IYR", "iShares U.S. Real Estate ETF"),
    ("XLRE", "Real Estate Select Sector SPDR"),
)

# ---------------------------------------------------------------------------
# FIXED VALUES — ticker -> CIK for the seed REITs (AVB and PSB as finally set)
# ---------------------------------------------------------------------------
CIK_BY_TICKER = (
    ("O", "0001043604"),
    ("AMT", "0001067983"),
    ("PLD", "0001093557"),
    ("SPG", "0000862009"),
    ("EQIX", "0001066196"),
    ("PSB", "0000720526"),
    ("AVB", "0000763522"),
    ("WELL", "0001393818"),
    ("DLR", "0001103982"),
    ("VICI", "0001701605"),
    ("CCI", "0001022079"),
    ("AMH", "0001526524"),
)

# ---------------------------------------------------------------------------
# FIXED VALUES — seed REIT master rows
# (ticker, name, sector, sub_sector, market_cap, ipo_year, property_count,
#  total_sqft, geographic_focus, dividend_yield, payout_ratio, latest_ffo_per_share)
# ---------------------------------------------------------------------------
SEED_REITS = (
    ("O", "Realty Income", "Retail", "Net Lease", 45e9, 1994, 13500, 280e6, "US & Europe", 5.8, 0.76, 4.05),
    ("AMT", "American Tower", "Infrastructure", "Tower", 110e9, 2012, 226000, 0.0, "Global", 3.4, 0.62, 9.82),
    ("PLD", "Prologis", "Industrial", "Logistics", 120e9, 1998, 5200, 1200e6, "Global", 2.9, 0.58, 6.15),
    ("SPG", "Simon Property Group", "Retail", "Mall", 55e9, 1993, 232, 186e6, "US & International", 4.5, 0.68, 12.30),
    ("EQIX", "Equinix", "DataCenter", "Colocation", 80e9, 2015, 260, 65e6, "Global", 2.1, 0.48, 33.50),
    ("PSB", "Public Storage", "Specialty", "Self Storage", 42e9, 1995, 3000, 250e6, "US & Europe", 4.2, 0.70, 14.20),
    ("AVB", "AvalonBay Communities", "Residential", "Apartment", 28e9, 1994, 295, 95e6, "US Coastal", 3.1, 0.64, 12.85),
    ("WELL", "Welltower", "Healthcare", "Senior Housing", 35e9, 2010, 2200, 180e6, "US, UK, Canada", 2.7, 0.55, 3.65),
    ("DLR", "Digital Realty", "DataCenter", "Data Center", 48e9, 2004, 310, 55e6, "Global", 3.2, 0.60, 7.40),
    ("VICI", "VICI Properties", "Specialty", "Gaming", 33e9, 2018, 93, 140e6, "US", 5.2, 0.74, 2.25),
    ("CCI", "Crown Castle", "Infrastructure", "Tower/Fiber", 38e9, 2014, 40800, 0.0, "US", 6.5, 0.82, 9.10),
    ("AMH", "American Homes 4 Rent", "Residential", "Single Family", 15e9, 2013, 59000, 120e6, "US Sun Belt", 2.4, 0.50, 1.95),
)

# ---------------------------------------------------------------------------
# FIXED VALUES — composite weights, in operand order
# ---------------------------------------------------------------------------
SCORE_WEIGHTS = (
    ("fundamental", 0.30),
    ("valuation", 0.25),
    ("momentum", 0.20),
    ("macro", 0.15),
    ("sentiment", 0.10),
)

NEUTRAL_SCORE = 50.0

# ---------------------------------------------------------------------------
# FIXED VALUES — risk / opportunity / data-source texts
# ---------------------------------------------------------------------------
RISK_FUNDAMENTAL = "Weak fundamental performance (low FFO/NOI growth)"
RISK_VALUATION = "Potentially overvalued relative to fundamentals"
RISK_MACRO = "Unfavorable macro environment (rising rates, inverted curve)"
RISK_LEVERAGE_FMT = "High leverage at {}x Debt/EBITDA"
OPP_FUNDAMENTAL = "Strong fundamental momentum (FFO/NOI growth)"
OPP_VALUATION = "Attractive valuation with high dividend yield"
OPP_MACRO = "Favorable macro tailwinds (falling rates, steep curve)"
SOURCE_FUNDAMENTALS = "financial_metrics"
SOURCE_PRICES = "alpha_vantage"
SOURCE_MACRO = "fred"

# ---------------------------------------------------------------------------
# FIXED VALUES — price analytics defaults
# ---------------------------------------------------------------------------
RETURN_PERIODS = ((21, "1m"), (63, "3m"), (126, "6m"), (252, "1y"))
MA_WINDOWS = (20, 50, 200)
VOLATILITY_WINDOW = 20
TRADING_DAYS = 252
COMPACT_HISTORY_ROWS = 100

# ---------------------------------------------------------------------------
# FIXED VALUES — filing sources
# ---------------------------------------------------------------------------
FILING_DATA_URL = "https://data.sec.gov"
FILING_SEARCH_START = "2020-01-01"
FILING_SEARCH_END = "2025-12-31"
FILING_TEXT_KEEP = 8000
RECORD_TEXT_KEEP = 500
NARRATIVE_KEEP = 4000
