"""Component scores, composite signal, ranking and the full per-REIT report.

Every score starts at 50, adds the first matching branch of each rule block
and is clamped to [0, 100]; a ticker without the input a score needs gets 50.
Model numbers default to 0.0, so NULL inputs are read as 0.0.  All tickers
are scored in one plan; the macro score, one value for all tickers, enters as a
scalar subquery (evaluated once, no join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reitlens import constants as K
from reitlens.functions import scalars as S
from reitlens.functions.text import py_fixed, py_round
from reitlens.operators.fundamentals import latest_metric
from reitlens.operators.ranking import rank_within

N = K.NEUTRAL_SCORE


def _z(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def _pts(*branches, default=0) -> Column:
    """First matching (condition, points) wins."""
    expr = None
    for cond, pts in branches:
        expr = F.when(cond, pts) if expr is None else expr.when(cond, pts)
    return expr.otherwise(default)


def _score(*blocks: Column) -> Column:
    total = F.lit(N)
    for b in blocks:
        total = total + b
    return S.clamp_score(total.cast("double"))


# ---------------------------------------------------------------------------
# score rules as column expressions (over the input fields by name)
# ---------------------------------------------------------------------------

def fundamental_expr() -> Column:
    """FFO growth, NOI growth, leverage and interest coverage of the latest quarter."""
    g, noi = _z("ffo_growth_yoy"), _z("same_store_noi_growth")
    lev, cov = _z("net_debt_to_ebitda"), _z("interest_coverage")
    return _score(
        _pts((g > 10, 20), (g > 5, 15), (g > 0, 10), (g > -5, 0), default=-15),
        _pts((noi > 5, 20), (noi > 2, 15), (noi > 0, 8), default=-10),
        _pts((lev < 3.0, 10), (lev < 5.0, 5), (lev > 7.0, -10)),
        _pts((cov > 5, 5), (cov > 3, 3)),
    )


def valuation_expr() -> Column:
    """Dividend yield, payout band and FFO yield from the REIT master."""
    y, p, ffo = _z("dividend_yield"), _z("payout_ratio"), _z("latest_ffo_per_share")
    q = F.when(p > 0, S.safe_div(y, p)).otherwise(F.lit(0.0))
    return _score(
        F.least(y / F.lit(8.0), F.lit(1.0)) * F.lit(30.0),
        _pts(((p >= 0.50) & (p <= 0.75), 15), ((p >= 0.40) & (p <= 0.85), 8), (p > 0.90, -15)),
        F.when(ffo > 0, _pts((q > 0.08, 10), (q > 0.06, 5))).otherwise(0),
    )


def momentum_expr() -> Column:
    """3-month and 1-year returns and distance from the 200-day average.

    A missing return reads as 0; a missing 200-day distance adds nothing.
    """
    r3, r1 = _z("return_3m"), _z("return_1y")
    pct = F.col("pct_from_ma_200")
    return _score(
        _pts((r3 > 10, 25), (r3 > 5, 15), (r3 > 0, 8), (r3 > -10, -5), default=-20),
        _pts((r1 > 20, 15), (r1 > 10, 10), (r1 > 0, 5), (r1 < -15, -15)),
        F.when(pct.isNull(), 0).otherwise(_pts((pct > 10, 10), (pct > 0, 5), (pct < -10, -10))),
    )


def macro_expr() -> Column:
    """Rate assessment, curve, trend and unemployment."""
    a, c, t = F.col("rate_assessment"), F.col("curve_assessment"), F.col("rate_trend")
    u = F.col("unemployment_rate")
    return _score(
        _pts((a == "Accommodative", 20), (a == "Restrictive", -20)),
        _pts(((c == "Normal") | (c == "Steep"), 10), (c == "Inverted", -15)),
        _pts((t == "Falling", 15), (t == "Rising", -10)),
        F.when(u.isNull(), 0).otherwise(_pts(((u >= 3.5) & (u <= 5.0), 5), (u > 6.0, -10))),
    )


def sentiment_expr(has_metric: Column, has_master: Column) -> Column:
    """Dividend and NOI growth (with metrics) and market-cap tier (with a master row)."""
    d, noi, cap = _z("dividend_growth_yoy"), _z("same_store_noi_growth"), _z("market_cap")
    return _score(
        F.when(has_metric, _pts((d > 5, 15), (d > 0, 8), (d < 0, -10))).otherwise(0),
        F.when(has_metric, _pts((noi > 3, 10), (noi < 0, -10))).otherwise(0),
        F.when(has_master, _pts((cap > 50e9, 10), (cap > 20e9, 5))).otherwise(0),
    )


# ---------------------------------------------------------------------------
# one score per frame (the individual operators)
# ---------------------------------------------------------------------------

def fundamental_score(metrics_latest: DataFrame) -> DataFrame:
    return metrics_latest.select(F.col("reit_ticker").alias("ticker"),
                                 fundamental_expr().alias("fundamental_score"))


def valuation_score(reits: DataFrame) -> DataFrame:
    return reits.select("ticker", valuation_expr().alias("valuation_score"))


def momentum_score(summary: DataFrame) -> DataFrame:
    """``summary`` is the flat ``prices.price_metrics`` frame."""
    return summary.select("ticker", momentum_expr().alias("momentum_score"))


def macro_score(env: DataFrame) -> DataFrame:
    """One row from the one-row ``rate_environment`` frame."""
    return env.select(macro_expr().alias("macro_score"))


def sentiment_score(reits: DataFrame, metrics_latest: DataFrame) -> DataFrame:
    """Every ticker with a master row or metrics (full outer join)."""
    m = metrics_latest.select(F.col("reit_ticker").alias("ticker"), "dividend_growth_yoy",
                              "same_store_noi_growth", F.lit(True).alias("_has_m"))
    r = reits.select("ticker", "market_cap", F.lit(True).alias("_has_r"))
    j = r.join(m, "ticker", "full")
    has_m, has_r = F.coalesce("_has_m", F.lit(False)), F.coalesce("_has_r", F.lit(False))
    return j.select("ticker", sentiment_expr(has_m, has_r).alias("sentiment_score"))


def composite(f: Column, v: Column, m: Column, ma: Column, s: Column) -> Column:
    """Weighted sum in the fixed operand order, rounded to 2 like Python's ``round``."""
    w = dict(K.SCORE_WEIGHTS)
    total = (f * F.lit(w["fundamental"]) + v * F.lit(w["valuation"]) + m * F.lit(w["momentum"])
             + ma * F.lit(w["macro"]) + s * F.lit(w["sentiment"]))
    return py_round(total, 2)


def generate_signals(reits: DataFrame, metrics: DataFrame, price_summary: DataFrame | None,
                     env: DataFrame | None, latest: DataFrame | None = None) -> DataFrame:
    """All five scores, composite, rating and sentiment for every REIT.

    The inputs are joined once per ticker (master ⟕ latest metrics ⟕ price
    summary, plus the one-row macro frame) and every score is computed in a
    single projection, so each big frame is shuffled at most once.
    ``price_summary`` (flat ``price_metrics``) or ``env`` (``rate_environment``)
    may be None, meaning that source is not configured: the score is then 50.
    ``latest`` may pass an already built ``latest_metric(metrics)`` frame.
    """
    lm = latest if latest is not None else latest_metric(metrics)
    r = reits.select("ticker", "dividend_yield", "payout_ratio", "latest_ffo_per_share", "market_cap")
    m = lm.select(F.col("reit_ticker").alias("ticker"), "ffo_growth_yoy", "same_store_noi_growth",
                  "net_debt_to_ebitda", "interest_coverage", "dividend_growth_yoy",
                  F.lit(True).alias("_has_m"))
    j = r.join(m, "ticker", "left")
    momentum = F.lit(N)
    if price_summary is not None:
        p = price_summary.select("ticker", "return_3m", "return_1y", "pct_from_ma_200",
                                 F.lit(True).alias("_has_p"))
        j = j.join(p, "ticker", "left")
        momentum = F.when(F.coalesce("_has_p", F.lit(False)), momentum_expr()).otherwise(F.lit(N))
    macro = F.lit(N)
    if env is not None:
        # one value for every ticker: a scalar subquery, evaluated once, no join
        macro = macro_score(env).scalar()
    has_m = F.coalesce("_has_m", F.lit(False))
    scored = j.select(
        "ticker",
        F.when(has_m, fundamental_expr()).otherwise(F.lit(N)).alias("fundamental_score"),
        valuation_expr().alias("valuation_score"),
        momentum.alias("momentum_score"),
        macro.alias("macro_score"),
        sentiment_expr(has_m, F.lit(True)).alias("sentiment_score"),
    )
    names = ("fundamental_score", "valuation_score", "momentum_score", "macro_score",
             "sentiment_score")
    sc = composite(*[F.col(c) for c in names])
    return scored.select(
        F.col("ticker").alias("reit_ticker"), *names,
        sc.alias("composite_score"),
        S.signal_rating(sc).alias("signal_rating"),
        S.sentiment_label(sc).alias("sentiment"),
    )


def compare_signals(signals: DataFrame) -> DataFrame:
    """Rank by composite descending; ties keep input (ticker) order. Exact, distributed."""
    ranked = rank_within(signals, [], [F.col("composite_score").desc(), F.col("reit_ticker").asc()],
                         "rank", method="row_number")
    return ranked.select(
        "rank", F.col("reit_ticker").alias("ticker"), "composite_score",
        F.col("signal_rating").alias("rating"),
        F.col("fundamental_score").alias("fundamental"),
        F.col("valuation_score").alias("valuation"),
        F.col("momentum_score").alias("momentum"),
        F.col("macro_score").alias("macro"),
        F.col("sentiment_score").alias("sentiment"),
    )


def _flags(*items) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(msg) if isinstance(msg, str) else msg)
                              for c, msg in items]), lambda x: x.isNotNull())


def full_report(reits: DataFrame, metrics: DataFrame, price_summary: DataFrame | None,
                env: DataFrame | None) -> DataFrame:
    """Signal plus risks, opportunities, confidence and data sources for every REIT."""
    latest = latest_metric(metrics)
    sig = generate_signals(reits, metrics, price_summary, env, latest)
    lm = latest.select(F.col("reit_ticker"), "net_debt_to_ebitda", F.lit(True).alias("_has_m"))
    j = sig.join(lm, "reit_ticker", "left")
    has_m = F.coalesce("_has_m", F.lit(False))
    lev = F.col("net_debt_to_ebitda")
    f, v, ma = F.col("fundamental_score"), F.col("valuation_score"), F.col("macro_score")
    lev_msg = F.concat(F.lit("High leverage at "), py_fixed(lev, 1), F.lit("x Debt/EBITDA"))
    risks = _flags((f < 40, K.RISK_FUNDAMENTAL), (v < 35, K.RISK_VALUATION),
                   (ma < 40, K.RISK_MACRO), (has_m & (lev > 6.0), lev_msg))
    opps = _flags((f > 70, K.OPP_FUNDAMENTAL), (v > 70, K.OPP_VALUATION), (ma > 70, K.OPP_MACRO))
    has_p, has_e = F.lit(price_summary is not None), F.lit(env is not None)
    conf = F.round((has_m.cast("int") + has_p.cast("int") + has_e.cast("int")) / F.lit(3.0), 2)
    sources = _flags((has_m, K.SOURCE_FUNDAMENTALS), (has_p, K.SOURCE_PRICES),
                     (has_e, K.SOURCE_MACRO))
    return j.select(
        "reit_ticker", "fundamental_score", "valuation_score", "momentum_score", "macro_score",
        "sentiment_score", "composite_score", "signal_rating", "sentiment",
        risks.alias("key_risks"), opps.alias("key_opportunities"),
        sources.alias("data_sources"), conf.alias("confidence_score"),
    )


def signals_for_sink(report: DataFrame, generated_at: Column, status: Column | None = None,
                     analysis: Column | None = None) -> DataFrame:
    """Rows the signal writer appends: computed rows only, defaults filled, lists as JSON.

    Absent scores default to 50, rating to ``Hold``, confidence to 0.5; the
    narrative is cut to 4,000 characters.
    """
    r = report
    if status is not None:
        r = r.where(status == "computed")
    text = analysis if analysis is not None else F.lit("")
    d = lambda c: F.coalesce(F.col(c), F.lit(N))
    return r.select(
        S.signal_id("reit_ticker", generated_at).alias("signal_id"),
        F.col("reit_ticker").alias("ticker"),
        generated_at.alias("generated_at"),
        d("composite_score").alias("composite_score"),
        d("fundamental_score").alias("fundamental_score"),
        d("valuation_score").alias("valuation_score"),
        d("momentum_score").alias("momentum_score"),
        d("macro_score").alias("macro_score"),
        d("sentiment_score").alias("sentiment_score"),
        F.coalesce("signal_rating", F.lit("Hold")).alias("signal_rating"),
        S.excerpt(F.coalesce(text, F.lit("")), K.NARRATIVE_KEEP).alias("ai_analysis"),
        F.to_json(F.coalesce("key_risks", F.array().cast("array<string>"))).alias("key_risks"),
        F.to_json(F.coalesce("key_opportunities", F.array().cast("array<string>")))
        .alias("key_opportunities"),
        F.coalesce("confidence_score", F.lit(0.5)).alias("confidence_score"),
    )
