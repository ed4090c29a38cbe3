"""REIT fundamentals: the fundamentals view and the latest-quarter lookups.

All operators are set-based over every ticker at once.  Joins between the
REIT master and the metrics are equi-joins on the ticker; Spark picks the
strategy from sizes (AQE turns a small side into a broadcast at run time, a
large one stays a sort-merge join), so no side is hinted here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reitlens.functions import scalars as S

METRIC_COLUMNS = (
    "reit_ticker", "period", "fiscal_year", "quarter", "total_revenue", "same_store_noi",
    "same_store_noi_growth", "ffo_per_share", "affo_per_share", "ffo_growth_yoy",
    "net_debt_to_ebitda", "interest_coverage", "weighted_avg_cap_rate", "dividend_per_share",
    "dividend_growth_yoy",
)


def reit_fundamentals(reits: DataFrame, metrics: DataFrame) -> DataFrame:
    """REIT master ⋈ quarterly metrics with payout ratios, leverage and safety bands.

    The view's LEFT JOIN is followed by ``quarter IS NOT NULL``, which rejects the
    padded rows, so it is an inner join; Catalyst would do the same rewrite.
    Ordered by sector, then FFO per share descending, NULLs last.
    """
    r = reits.select("ticker", "name", "sector", "sub_sector", "dividend_yield", "payout_ratio")
    m = metrics.where(F.col("quarter").isNotNull())
    j = r.join(m, r.ticker == m.reit_ticker, "inner")
    return j.select(
        "ticker", "name", "sector", "sub_sector", "fiscal_year", "quarter",
        "ffo_per_share", "affo_per_share", "ffo_growth_yoy", "same_store_noi",
        "same_store_noi_growth", "dividend_per_share", "dividend_growth_yoy",
        "net_debt_to_ebitda", "interest_coverage", "dividend_yield", "payout_ratio",
        S.payout_ratio_sql("dividend_per_share", "affo_per_share").alias("affo_payout_ratio"),
        S.payout_ratio_sql("dividend_per_share", "ffo_per_share").alias("ffo_payout_ratio"),
        S.leverage_rating("net_debt_to_ebitda").alias("leverage_rating"),
        S.dividend_safety_sql("dividend_per_share", "affo_per_share").alias("dividend_safety"),
        "created_at",
    ).orderBy(F.col("sector").asc_nulls_last(), F.col("ffo_per_share").desc_nulls_last())


def latest_metric(metrics: DataFrame) -> DataFrame:
    """Newest (fiscal_year, quarter) row per ticker; one row per ticker.

    Ties on (year, quarter) keep load order when a ``load_seq`` column exists
    (see ``operators.loaders.load_metrics``), otherwise the smallest period label.
    Written as a ``min_by`` aggregate over a sort key rather than a window, so
    it is partially aggregated: a ticker with a third of all rows is reduced
    map-side and never sorted in one task.
    """
    y, q = F.col("fiscal_year"), F.col("quarter")
    tie = F.col("load_seq") if "load_seq" in metrics.columns else F.col("period")
    # ascending key = (year desc, quarter desc, tie asc), NULL years/quarters last
    key = F.struct(y.isNull(), -y, q.isNull(), -q, tie.isNull(), tie)
    row = F.struct(*[F.col(c) for c in metrics.columns])
    return (metrics.groupBy("reit_ticker").agg(F.min_by(row, key).alias("_m"))
            .select("_m.*"))


def latest_metric_ranked(metrics: DataFrame) -> DataFrame:
    """All rows at each ticker's max (fiscal_year, quarter): duplicates all survive."""
    w = Window.partitionBy("reit_ticker").orderBy(F.col("fiscal_year").desc(),
                                                  F.col("quarter").desc())
    return (metrics.withColumn("_rk", F.rank().over(w))
            .where(F.col("_rk") == 1).drop("_rk"))


def max_period(metrics: DataFrame) -> DataFrame:
    """MAX(fiscal_year) and, within it, MAX(quarter) per ticker (a single aggregate)."""
    top = F.max(F.struct("fiscal_year", "quarter"))
    return metrics.groupBy("reit_ticker").agg(top.alias("_top")).select(
        "reit_ticker", F.col("_top.fiscal_year").alias("max_fiscal_year"),
        F.col("_top.quarter").alias("max_quarter"))


def join_latest_metric(reits: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every REIT with its latest-quarter metrics; REITs without metrics keep NULLs.

    The original correlated MAX inside the join condition is rewritten as a
    per-ticker max-key aggregate joined back on (ticker, year, quarter), so all
    rows at the latest key survive, as they would in the original.
    """
    top = max_period(metrics)
    latest = metrics.join(
        top,
        (metrics.reit_ticker == top.reit_ticker)
        & (metrics.fiscal_year == top.max_fiscal_year)
        & (metrics.quarter == top.max_quarter),
        "left_semi",
    )
    r = reits.select("ticker", "name", "sector", "sub_sector", "dividend_yield", "payout_ratio")
    m = latest.select("reit_ticker", "ffo_per_share", "affo_per_share",
                      "same_store_noi_growth", "ffo_growth_yoy", "net_debt_to_ebitda",
                      "interest_coverage", "weighted_avg_cap_rate", "dividend_growth_yoy")
    return r.join(m, r.ticker == m.reit_ticker, "left").drop("reit_ticker")


def filter_fiscal_year(metrics: DataFrame, fiscal_year: int) -> DataFrame:
    return metrics.where(F.col("fiscal_year") == F.lit(fiscal_year))


def by_ticker(reits: DataFrame, ticker: str) -> DataFrame:
    """Point lookup after normalising the probe the same way tickers are stored."""
    return reits.where(F.col("ticker") == S.norm_ticker(F.lit(ticker)))


def by_sector(reits: DataFrame, sector: str) -> DataFrame:
    return reits.where(F.col("sector") == F.lit(sector))
