"""Score rule blocks at, just below and just above every threshold."""

import pytest
from pyspark.sql import functions as F

from reitlens.operators import scores as SC

MET = ("reit_ticker string, ffo_growth_yoy double, same_store_noi_growth double, net_debt_to_ebitda double, "
       "interest_coverage double, dividend_growth_yoy double")


def fund(spark, g, noi, lev, cov):
    df = spark.createDataFrame([("X", g, noi, lev, cov, 0.0)], MET)
    return SC.fundamental_score(df).first()["fundamental_score"]


@pytest.mark.parametrize("g,pts", [(10.01, 20), (10.0, 15), (5.0, 10), (0.0, 0), (-4.99, 0), (-5.0, -15), (None, 0)])
def test_fundamental_ffo_growth_block(spark, g, pts):
    # noi 5.01 → +20, lev 5.0 → 0, cov 0 → 0
    assert fund(spark, g, 5.01, 5.0, 0.0) == 50 + pts + 20


@pytest.mark.parametrize("noi,pts", [(5.01, 20), (5.0, 15), (2.0, 8), (0.0, -10), (None, -10)])
def test_fundamental_noi_block(spark, noi, pts):
    assert fund(spark, 0.0, noi, 5.0, 0.0) == 50 + 0 + pts


@pytest.mark.parametrize("lev,pts", [(2.99, 10), (3.0, 5), (4.99, 5), (5.0, 0), (7.0, 0), (7.01, -10)])
def test_fundamental_leverage_block(spark, lev, pts):
    assert fund(spark, 0.0, 5.01, lev, 0.0) == 50 + 20 + pts


@pytest.mark.parametrize("cov,pts", [(5.01, 5), (5.0, 3), (3.01, 3), (3.0, 0)])
def test_fundamental_coverage_block(spark, cov, pts):
    assert fund(spark, 0.0, 5.01, 5.0, cov) == 70 + pts


def test_fundamental_clamped(spark):
    assert fund(spark, 20.0, 10.0, 1.0, 9.0) == 100.0
    assert fund(spark, -20.0, -1.0, 9.0, 0.0) == 15.0


REIT = "ticker string, dividend_yield double, payout_ratio double, latest_ffo_per_share double, market_cap double"


@pytest.mark.parametrize("y,p,ffo,expected", [
    (8.0, 0.50, 1.0, 100), (4.0, 0.75, 1.0, 50 + 15 + 15 + 10), (4.0, 0.76, 1.0, 50 + 15 + 8 + 10),
    (4.0, 0.40, 1.0, 50 + 15 + 8 + 10), (4.0, 0.39, 1.0, 50 + 15 + 0 + 10), (4.0, 0.91, 1.0, 50 + 15 - 15 + 10),
    (4.0, 0.90, 1.0, 50 + 15 + 0 + 10), (16.0, 0.5, 0.0, 50 + 30 + 15), (0.04, 0.5, 1.0, 50 + 0.15 + 15 + 5),
    (0.0, 0.0, 1.0, 50.0),
])
def test_valuation_score(spark, y, p, ffo, expected):
    df = spark.createDataFrame([("X", y, p, ffo, 1e9)], REIT)
    got = SC.valuation_score(df).first()["valuation_score"]
    py = 50.0 + min(y / 8.0, 1.0) * 30
    py += 15 if 0.5 <= p <= 0.75 else 8 if 0.4 <= p <= 0.85 else -15 if p > 0.9 else 0
    if ffo > 0:
        q = y / p if p > 0 else 0
        py += 10 if q > 0.08 else 5 if q > 0.06 else 0
    assert got == max(0, min(100, py))
    assert got == pytest.approx(expected)


SUM = "ticker string, return_3m double, return_1y double, pct_from_ma_200 double"


@pytest.mark.parametrize("r3,r1,pct,expected", [
    (10.01, 20.01, 10.01, 100), (10.0, 20.0, 10.0, 50 + 15 + 10 + 5), (0.0, 0.0, 0.0, 50 - 5 + 0 + 0),
    (None, None, None, 45), (-10.0, -15.0, -10.0, 50 - 20 + 0 + 0), (-10.01, -15.01, -10.01, 50 - 20 - 15 - 10),
    (0.01, 0.01, 0.01, 50 + 8 + 5 + 5),
])
def test_momentum_score(spark, r3, r1, pct, expected):
    df = spark.createDataFrame([("X", r3, r1, pct)], SUM)
    assert SC.momentum_score(df).first()["momentum_score"] == expected


ENV = "rate_assessment string, curve_assessment string, rate_trend string, unemployment_rate double"


@pytest.mark.parametrize("a,c,t,u,expected", [
    ("Accommodative", "Steep", "Falling", 4.0, 100), ("Restrictive", "Inverted", "Rising", 6.5, 0),
    ("Neutral", "Flat", "Stable", None, 50), ("Neutral", "Normal", "Stable", 3.5, 65), ("Neutral", "Normal", "Stable", 5.0, 65),
    ("Neutral", "Normal", "Stable", 6.0, 60), ("Neutral", "Normal", "Stable", 6.01, 50),
])
def test_macro_score(spark, a, c, t, u, expected):
    df = spark.createDataFrame([(a, c, t, u)], ENV)
    assert SC.macro_score(df).first()["macro_score"] == expected


def test_sentiment_score_with_and_without_inputs(spark):
    reits = spark.createDataFrame([("A", 0.0, 0.0, 0.0, 60e9), ("B", 0.0, 0.0, 0.0, 20e9)], REIT)
    met = spark.createDataFrame([("A", 0.0, 3.01, 0.0, 0.0, 5.01), ("C", 0.0, -0.1, 0.0, 0.0, -0.1)], MET)
    got = {r["ticker"]: r["sentiment_score"] for r in SC.sentiment_score(reits, met).collect()}
    assert got == {"A": 50 + 15 + 10 + 10, "B": 50.0, "C": 50 - 10 - 10}


@pytest.mark.parametrize("scores,composite,rating,sentiment", [
    ((50, 50, 50, 50, 50), 50.0, "Hold", "Neutral"),
    ((100, 100, 100, 100, 100), 100.0, "Strong Buy", "Very Bullish"),
    ((80, 80, 80, 80, 80), 80.0, "Strong Buy", "Bullish"),
    ((65, 65, 65, 65, 65), 65.0, "Buy", "Bullish"),
    ((35, 35, 35, 35, 35), 35.0, "Hold", "Bearish"),
    ((20, 20, 20, 20, 20), 20.0, "Sell", "Bearish"),
    ((0, 0, 0, 0, 0), 0.0, "Strong Sell", "Very Bearish"),
])
def test_composite_and_bands(spark, scores, composite, rating, sentiment):
    df = spark.createDataFrame([tuple(float(s) for s in scores)], "f double, v double, m double, ma double, s double")
    c = SC.composite(F.col("f"), F.col("v"), F.col("m"), F.col("ma"), F.col("s"))
    from reitlens.functions import scalars as S
    r = df.select(c.alias("c")).select("c", S.signal_rating("c").alias("r"), S.sentiment_label("c").alias("s")).first()
    assert (r["c"], r["r"], r["s"]) == (composite, rating, sentiment)


def test_composite_rounds_like_python(spark):
    vals = [(71.75, 86.125, 63.0, 35.0, 45.0), (61.2, 57.375, 45.0, 65.0, 70.0), (33.3, 66.6, 99.9, 12.5, 47.5)]
    df = spark.createDataFrame(vals, "f double, v double, m double, ma double, s double")
    got = [r["c"] for r in df.select(SC.composite(*[F.col(c) for c in ("f", "v", "m", "ma", "s")]).alias("c")).collect()]
    exp = [round(f * 0.30 + v * 0.25 + m * 0.20 + ma * 0.15 + s * 0.10, 2) for f, v, m, ma, s in vals]
    assert got == exp


def test_generate_signal_defaults_without_sources(spark):
    reits = spark.createDataFrame([("A", 4.0, 0.6, 1.0, 1e9)], REIT)
    met = spark.createDataFrame([], MET + ", fiscal_year int, quarter int, period string")
    sig = SC.generate_signals(reits, met, None, None).first()
    assert (sig["fundamental_score"], sig["momentum_score"], sig["macro_score"], sig["sentiment_score"]) == (50.0,) * 4
    assert sig["valuation_score"] == 50 + 15 + 15 + 10


def test_full_report_flags_and_confidence(spark):
    reits = spark.createDataFrame([("A", 1.0, 0.95, 1.0, 1e9)], REIT)
    met = spark.createDataFrame([("A", -20.0, -1.0, 6.25, 0.0, 0.0, 2024, 4, "2024Q4")],
                                MET + ", fiscal_year int, quarter int, period string")
    env = spark.createDataFrame([("Restrictive", "Inverted", "Rising", 7.0)], ENV)
    r = SC.full_report(reits, met, None, env).first()
    # the valuation score is at least 50 + 0 - 15 = 35, so its "< 35" risk never fires
    assert r["valuation_score"] >= 35
    assert r["key_risks"] == ["Weak fundamental performance (low FFO/NOI growth)",
                              "Unfavorable macro environment (rising rates, inverted curve)",
                              "High leverage at 6.2x Debt/EBITDA"]
    assert r["key_opportunities"] == []
    assert r["data_sources"] == ["financial_metrics", "fred"]
    assert r["confidence_score"] == 0.67


def test_compare_signals_ranks_ties_by_ticker(spark):
    rows = [("B", 1.0, 1.0, 1.0, 1.0, 1.0, 60.0, "Hold", "Neutral"), ("A", 1.0, 1.0, 1.0, 1.0, 1.0, 60.0, "Hold", "Neutral"),
            ("C", 1.0, 1.0, 1.0, 1.0, 1.0, 70.0, "Buy", "Bullish")]
    df = spark.createDataFrame(rows, "reit_ticker string, fundamental_score double, valuation_score double, "
                                     "momentum_score double, macro_score double, sentiment_score double, "
                                     "composite_score double, signal_rating string, sentiment string")
    got = [(r["rank"], r["ticker"]) for r in SC.compare_signals(df).orderBy("rank").collect()]
    assert got == [(1, "C"), (2, "A"), (3, "B")]
