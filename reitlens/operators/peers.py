"""Peer comparison, sector benchmarks, dividend safety and valuation.

Every operator runs for all tickers in one job.  Group-level figures (sector or
sub-sector sums and counts) are computed with partial aggregation and joined
back; their size is bounded by the number of sectors / sub-sectors, which come
from the fixed-size region and nation dimensions.  "Leave-one-out" peer
averages are ``(group sum - own value) / (group count - 1)`` rather than a
self-join, so no pairs within a group are ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reitlens.functions import scalars as S
from reitlens.functions.aggs import exact_avg, exact_sum
from reitlens.operators.fundamentals import latest_metric
from reitlens.operators.fetch import stored
from reitlens.operators.ranking import rank_stacked

DEFAULT_SECTOR = "Specialty"


def _z(c: str):
    """Model fields default to 0.0 rather than NULL."""
    return F.coalesce(F.col(c), F.lit(0.0))


# ---------------------------------------------------------------------------
# ETL flavour (fiscal-year filter, every quarter counted, self included)
# ---------------------------------------------------------------------------

def agg_peer_avg(reits: DataFrame, metrics: DataFrame, fiscal_year: int) -> DataFrame:
    m = metrics.where(F.col("fiscal_year") == F.lit(fiscal_year))
    j = reits.join(m, reits.ticker == m.reit_ticker)
    return j.groupBy("sub_sector").agg(
        exact_avg("ffo_per_share").alias("avg_ffo"),
        exact_avg("same_store_noi_growth").alias("avg_noi_growth"),
        exact_avg("net_debt_to_ebitda").alias("avg_leverage"),
        exact_avg("dividend_yield").alias("avg_yield"),
    )


def peer_comparison_etl(reits: DataFrame, metrics: DataFrame, fiscal_year: int) -> DataFrame:
    """Each metric row of the year minus its sub-sector average (self included)."""
    pa = agg_peer_avg(reits, metrics, fiscal_year)
    m = metrics.where(F.col("fiscal_year") == F.lit(fiscal_year))
    r = reits.select("ticker", "sub_sector", "dividend_yield")
    j = m.join(r, m.reit_ticker == r.ticker).join(pa, "sub_sector")
    return j.select(
        "reit_ticker", "ffo_per_share",
        (F.col("ffo_per_share") - F.col("avg_ffo")).alias("ffo_vs_peers"),
        (F.col("same_store_noi_growth") - F.col("avg_noi_growth")).alias("noi_vs_peers"),
        (F.col("net_debt_to_ebitda") - F.col("avg_leverage")).alias("leverage_vs_peers"),
        (F.col("dividend_yield") - F.col("avg_yield")).alias("yield_vs_peers"),
    )


def agg_sector_benchmarks_etl(reits: DataFrame, metrics: DataFrame, fiscal_year: int,
                              computed_at=None) -> DataFrame:
    """Sector benchmark rows for one fiscal year (count of metric rows, unrounded averages)."""
    m = metrics.where(F.col("fiscal_year") == F.lit(fiscal_year))
    j = reits.join(m, reits.ticker == m.reit_ticker)
    out = j.groupBy("sector").agg(
        F.count(F.lit(1)).alias("reit_count"),
        exact_avg("ffo_per_share").alias("avg_ffo"),
        exact_avg("same_store_noi_growth").alias("avg_noi_growth"),
        exact_avg("net_debt_to_ebitda").alias("avg_leverage"),
        exact_avg("dividend_yield").alias("avg_yield"),
        exact_avg("weighted_avg_cap_rate").alias("avg_cap_rate"),
    )
    if computed_at is not None:
        out = out.withColumn("computed_at", computed_at)
    return out


# ---------------------------------------------------------------------------
# service flavour (latest quarter per ticker, rounded, leave-one-out)
# ---------------------------------------------------------------------------

def agg_sector_benchmarks(reits: DataFrame, metrics: DataFrame) -> DataFrame:
    """Benchmarks over each ticker's latest row; tickers without a REIT are skipped."""
    lm = latest_metric(metrics)
    j = lm.join(reits, lm.reit_ticker == reits.ticker, "inner")
    return j.groupBy("sector").agg(
        F.count(F.lit(1)).alias("reit_count"),
        F.round(exact_avg(_z("ffo_per_share")), 2).alias("avg_ffo"),
        F.round(exact_avg(_z("same_store_noi_growth")), 2).alias("avg_noi_growth"),
        F.round(exact_avg(_z("net_debt_to_ebitda")), 2).alias("avg_leverage"),
        F.round(exact_avg(_z("dividend_yield")), 2).alias("avg_yield"),
        F.round(exact_avg(_z("weighted_avg_cap_rate")), 4).alias("avg_cap_rate"),
    )


def peer_comparison(reits: DataFrame, metrics: DataFrame) -> DataFrame:
    """Sector ranks and leave-one-out peer averages for every ticker with metrics.

    * ranks: 1 + number of sector peers strictly ahead (the subject wins ties);
      FFO and NOI-growth ranks count peers with metrics, the yield rank counts
      every REIT of the sector;
    * averages: over peers with metrics, self excluded;
    * no peer with metrics: all ranks 1, ``peer_count`` 0, the rest NULL;
    * a ticker with metrics but no master row is ranked alone in ``Specialty``.
    """
    lm = latest_metric(metrics).select(
        F.col("reit_ticker").alias("m_ticker"), _z("ffo_per_share").alias("ffo"),
        _z("same_store_noi_growth").alias("noi"), _z("net_debt_to_ebitda").alias("lev"))
    r = reits.select("ticker", "sector", "dividend_yield")
    # one full join holds the ranked REITs, those with a yield only, and metrics without a master row
    both = stored(r.join(lm, r.ticker == lm.m_ticker, "full"), "peers")
    listed, measured = F.col("ticker").isNotNull(), F.col("m_ticker").isNotNull()

    ranks = rank_stacked(both.where(listed), "ticker", "sector", [
        ("dividend_yield_rank", F.col("dividend_yield"), listed),
        ("ffo_rank", F.col("ffo"), measured),
        ("noi_growth_rank", F.col("noi"), measured)])
    rm = both.where(listed & measured).select("ticker", "sector", "ffo", "noi", "lev")
    sums = rm.groupBy("sector").agg(
        F.count(F.lit(1)).alias("n"), exact_sum("ffo").alias("s_ffo"),
        exact_sum("noi").alias("s_noi"), exact_sum("lev").alias("s_lev"))
    k = F.col("n") - 1
    has_peers = k > 0
    avg_ffo = S.safe_div(F.col("s_ffo") - F.col("ffo"), k)
    avg_noi = S.safe_div(F.col("s_noi") - F.col("noi"), k)
    avg_lev = S.safe_div(F.col("s_lev") - F.col("lev"), k)
    ranked = rm.join(sums, "sector").join(ranks, "ticker")

    def peer(c):
        return F.when(has_peers, c)

    with_master = ranked.select(
        "ticker", "sector",
        k.cast("int").alias("peer_count"),
        peer(F.col("ffo")).alias("ffo_per_share"),
        F.when(has_peers, F.col("ffo_rank")).otherwise(1).alias("ffo_rank"),
        peer(F.round(F.col("ffo") - avg_ffo, 2)).alias("ffo_vs_peers"),
        peer(F.col("noi")).alias("noi_growth"),
        F.when(has_peers, F.col("noi_growth_rank")).otherwise(1).alias("noi_growth_rank"),
        peer(F.round(F.col("noi") - avg_noi, 2)).alias("noi_growth_vs_peers"),
        F.when(has_peers, F.col("dividend_yield_rank")).otherwise(1).alias("dividend_yield_rank"),
        peer(F.col("lev")).alias("leverage"),
        peer(F.round(F.col("lev") - avg_lev, 2)).alias("leverage_vs_peers"),
        peer(F.round(avg_ffo, 2)).alias("avg_peer_ffo"),
        peer(F.round(avg_noi, 2)).alias("avg_peer_noi_growth"),
        peer(F.round(avg_lev, 2)).alias("avg_peer_leverage"),
    )
    orphans = both.where(~listed).select(
        F.col("m_ticker").alias("ticker"), F.lit(DEFAULT_SECTOR).alias("sector"),
        F.lit(0).alias("peer_count"), F.lit(None).cast("double").alias("ffo_per_share"),
        F.lit(1).alias("ffo_rank"), F.lit(None).cast("double").alias("ffo_vs_peers"),
        F.lit(None).cast("double").alias("noi_growth"), F.lit(1).alias("noi_growth_rank"),
        F.lit(None).cast("double").alias("noi_growth_vs_peers"),
        F.lit(1).alias("dividend_yield_rank"), F.lit(None).cast("double").alias("leverage"),
        F.lit(None).cast("double").alias("leverage_vs_peers"),
        F.lit(None).cast("double").alias("avg_peer_ffo"),
        F.lit(None).cast("double").alias("avg_peer_noi_growth"),
        F.lit(None).cast("double").alias("avg_peer_leverage"),
    )
    return with_master.unionByName(orphans)


def sector_peers(reits: DataFrame, tickers: list[str]) -> DataFrame:
    """Peers (same sector, other ticker) of the requested tickers.

    A point query: probe tickers are normalised like stored ones (strip, upper)
    and looked up with ``isin``; their sectors are then equi-joined with the
    master.  It is never run for every ticker at once, which would emit all
    pairs of a sector.
    """
    probes = sorted({t.strip().upper() for t in tickers})
    subj = reits.where(F.col("ticker").isin(*probes)).select("ticker", "sector")
    peers = reits.select(F.col("ticker").alias("peer_ticker"), F.col("sector"))
    return (subj.join(peers, "sector")
            .where(F.col("peer_ticker") != F.col("ticker"))
            .select("ticker", "sector", "peer_ticker"))


def _leave_one_out_yield(reits: DataFrame) -> DataFrame:
    """Mean yield of the other REITs in the sector; own yield when alone."""
    s = reits.groupBy("sector").agg(F.count(F.lit(1)).alias("_n"),
                                    exact_sum(_z("dividend_yield")).alias("_s"))
    j = reits.join(s, "sector")
    own = _z("dividend_yield")
    loo = F.when(F.col("_n") > 1, S.safe_div(F.col("_s") - own, F.col("_n") - 1)).otherwise(own)
    return j.select("ticker", loo.alias("avg_sector_yield_raw"))


def _guarded(reits: DataFrame, metrics: DataFrame) -> tuple[DataFrame, Column]:
    """One full outer join of master rows and latest metrics, and whether a row has both; ``ticker`` is that of the side that is there."""
    lm = latest_metric(metrics).withColumn("has_metrics", F.lit(True))
    r = reits.withColumnRenamed("ticker", "master_ticker")
    both = r.join(lm, F.col("master_ticker") == F.col("reit_ticker"), "full").withColumn("ticker", F.coalesce("master_ticker", "reit_ticker"))
    return both, F.col("master_ticker").isNotNull() & F.col("has_metrics").isNotNull()


def _error(present: Column) -> Column:
    return F.when(~present, "Insufficient data").alias("error")


def dividend_safety(reits: DataFrame, metrics: DataFrame) -> DataFrame:
    """Payout ratios, coverage, growth spread, 0–100 safety score and risk level; an error where either side is missing."""
    both, present = _guarded(reits, metrics)
    payout = S.payout_ratio_model("dividend_per_share", "affo_per_share")
    ffo_payout = S.payout_ratio_model("dividend_per_share", "ffo_per_share")
    spread = S.growth_spread("ffo_growth_yoy", "dividend_growth_yoy")
    g = _z("ffo_growth_yoy")
    score = (F.lit(50.0)
             + F.when(payout <= 0.60, 30).when(payout <= 0.70, 20).when(payout <= 0.80, 10)
             .when(payout > 0.90, -20).otherwise(0)
             + F.when(spread > 2.0, 15).when(spread > 0, 5).when(spread < -2.0, -15).otherwise(0)
             + F.when(g > 5.0, 5).when(g < 0, -10).otherwise(0))
    score = S.clamp_score(score.cast("double"))

    def ok(c, name):
        return F.when(present, c).alias(name)

    return both.select(
        "ticker",
        ok(F.round(payout, 4), "affo_payout_ratio"),
        ok(F.round(ffo_payout, 4), "ffo_payout_ratio"),
        ok(S.dividend_safety_model("dividend_per_share", "affo_per_share"), "dividend_safety"),
        ok(F.round(F.when(payout <= 1.0, F.lit(1.0) - payout).otherwise(F.lit(0.0)), 4), "affo_coverage"),
        ok(F.round(spread, 2), "ffo_growth_vs_div_growth"),
        ok(score, "safety_score"),
        ok(F.when(score >= 70, "Low").when(score >= 40, "Moderate").otherwise("High"), "risk_level"),
        _error(present))


def valuation(reits: DataFrame, metrics: DataFrame) -> DataFrame:
    """P/FFO, FFO yield, yield vs sector, EV/EBITDA and cap rate per ticker; an error where either side is missing."""
    both, present = _guarded(reits.join(_leave_one_out_yield(reits), "ticker"), metrics)
    y, p = _z("dividend_yield"), _z("payout_ratio")
    ffo_yield = F.when(p > 0, S.safe_div(y, p)).otherwise(F.lit(0.0))
    ebitda = _z("same_store_noi") * F.lit(1.15)
    cap = _z("market_cap")

    def ok(c, name):
        return F.when(present, c).alias(name)

    return both.select(
        "ticker",
        ok(F.round(F.when(ffo_yield > 0, S.safe_div(F.lit(1.0), ffo_yield)).otherwise(F.lit(0.0)), 2), "p_ffo"),
        ok(F.when(ffo_yield != 0, F.round(ffo_yield * F.lit(100.0), 2)).otherwise(F.lit(0.0)), "ffo_yield"),
        ok(F.col("dividend_yield"), "dividend_yield"),
        ok(F.round(y - F.col("avg_sector_yield_raw"), 2), "dividend_yield_vs_sector"),
        ok(F.round(F.col("avg_sector_yield_raw"), 2), "avg_sector_yield"),
        ok(F.round(F.when(ebitda > 0, S.safe_div(cap, ebitda * F.lit(1e6))).otherwise(F.lit(0.0)), 1), "ev_ebitda"),
        ok(F.col("weighted_avg_cap_rate"), "cap_rate"),
        _error(present))
