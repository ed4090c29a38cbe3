"""Price analytics: returns, moving averages, volatility and summaries.

One pass per ticker.  The only window is ``row_number()`` over each ticker's
history ordered newest first; a ticker's history is bounded by the number of
trading days (prices are one row per ticker and date), so no partition grows
with the raw data.  Everything else is a conditional aggregate per ticker.

Rules (all tickers at once):
* returns over N rows: latest close vs the close N rows back, in percent,
  rounded to 2; absent unless more than N rows; nothing with fewer than 2 rows;
* moving average over W: mean of the newest W closes rounded to 2, plus the
  latest close's distance from the unrounded mean in percent; NULL with
  fewer than W rows;
* volatility: population standard deviation of the newest ``window`` daily
  simple returns, daily in percent (4 decimals) and annualised with √252 (2
  decimals); both 0.0 with fewer than ``window + 1`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reitlens import constants as K
from reitlens.functions.exact import UNITS, WHOLE, from_units, ratio_round, round_div, to_units

STANDARD_LABELS = dict(K.RETURN_PERIODS)


def return_label(n: int) -> str:
    return f"return_{STANDARD_LABELS.get(n, f'{n}d')}"


def history(prices: DataFrame, history_rows: int | None = None) -> DataFrame:
    """Per ticker, rows numbered newest first (``rn``); optionally the newest N only."""
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    h = (prices.select("ticker", "date", "close", "volume")
         .withColumn("rn", F.row_number().over(w))
         .withColumn("close_u", to_units("close")))
    if history_rows is not None:
        h = h.where(F.col("rn") <= history_rows)
    return h


def compact_feed(prices: DataFrame, rows: int = K.COMPACT_HISTORY_ROWS) -> DataFrame:
    """The newest ``rows`` bars per ticker, whole bars: the rank filter lets every task drop older ones before the shuffle."""
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    return prices.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= rows).drop("rn")


def _latest_cols() -> list[Column]:
    first = F.col("rn") == 1
    return [F.max(F.when(first, F.col("close"))).alias("price"),
            F.max(F.when(first, F.col("date"))).alias("date"),
            F.max(F.when(first, F.col("volume"))).alias("volume"),
            F.max(F.when(first, F.col("close_u"))).alias("_cur_u"),
            F.count(F.lit(1)).alias("_n")]


def _per_ticker(h: DataFrame, periods: Sequence[int], windows: Sequence[int], *more: Column) -> DataFrame:
    aggs = [*_latest_cols(), *more]
    for p in periods:
        aggs.append(F.max(F.when(F.col("rn") == p + 1, F.col("close_u"))).alias(f"_past_{p}"))
    for w in windows:
        aggs.append(F.sum(F.when(F.col("rn") <= w, F.col("close_u"))).alias(f"_sum_{w}"))
    return h.groupBy("ticker").agg(*aggs)


def _return_cols(periods: Sequence[int]) -> list[Column]:
    cur, n = F.col("_cur_u"), F.col("_n")
    out = []
    for p in periods:
        past = F.col(f"_past_{p}")
        out.append(F.when((n >= 2) & (n > p), ratio_round((cur - past) * 100, past, 2))
                   .alias(return_label(p)))
    return out


def _ma_cols(windows: Sequence[int]) -> list[Column]:
    cur, n = F.col("_cur_u"), F.col("_n")
    out = []
    for w in windows:
        s = F.col(f"_sum_{w}")
        ok = n >= w
        out.append(F.when(ok, from_units(round_div(s, F.lit(w * UNITS // 100)), 2)).alias(f"ma_{w}"))
        out.append(F.when(ok, ratio_round((cur * w - s) * 100, s, 2)).alias(f"pct_from_ma_{w}"))
    return out


def _volatility(h: DataFrame, window: int) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    older = F.lead("close", 1).over(w)
    r = h.select("ticker", "rn", F.try_divide(F.col("close") - older, older).alias("r"))
    agg = (r.where(F.col("rn") <= window)
           .groupBy("ticker")
           .agg(F.stddev_pop("r").alias("_sd"), F.count("r").alias("_nr")))
    return agg


def _vol_cols(window: int) -> list[Column]:
    ok = F.col("_n") >= window + 1
    sd = F.col("_sd")
    return [F.when(ok, F.round(sd * F.lit(100.0), 4)).otherwise(F.lit(0.0)).alias("volatility_daily"),
            F.when(ok, F.round(sd * F.sqrt(F.lit(float(K.TRADING_DAYS))) * F.lit(100.0), 2))
            .otherwise(F.lit(0.0)).alias("volatility_annual")]


def period_returns(prices: DataFrame, periods: Sequence[int] = tuple(p for p, _ in K.RETURN_PERIODS),
                   history_rows: int | None = None) -> DataFrame:
    g = _per_ticker(history(prices, history_rows), periods, ())
    return g.select("ticker", *_return_cols(periods))


def moving_averages(prices: DataFrame, windows: Sequence[int] = K.MA_WINDOWS,
                    history_rows: int | None = None) -> DataFrame:
    g = _per_ticker(history(prices, history_rows), (), windows)
    return g.select("ticker", *_ma_cols(windows))


def volatility(prices: DataFrame, window: int = K.VOLATILITY_WINDOW,
               history_rows: int | None = None) -> DataFrame:
    h = history(prices, history_rows)
    g = h.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n"))
    v = _volatility(h, window)
    return g.join(v, "ticker", "left").select("ticker", *_vol_cols(window))


def price_metrics(prices: DataFrame, periods: Sequence[int] = tuple(p for p, _ in K.RETURN_PERIODS),
                  windows: Sequence[int] = K.MA_WINDOWS, window: int = K.VOLATILITY_WINDOW,
                  history_rows: int | None = None) -> DataFrame:
    """Flat summary per ticker: latest price/date/volume, returns, averages, volatility; one pass over the history."""
    h = history(prices, history_rows)
    older = F.lead("close", 1).over(Window.partitionBy("ticker").orderBy(F.col("date").desc()))
    h = h.withColumn("r", F.when(F.col("rn") <= window, F.try_divide(F.col("close") - older, older)))
    g = _per_ticker(h, periods, windows, F.stddev_pop("r").alias("_sd"))
    return g.select("ticker", "price", "date", "volume", *_return_cols(periods),
                    *_ma_cols(windows), *_vol_cols(window))


def price_summary(prices: DataFrame, history_rows: int | None = None, **kw) -> DataFrame:
    """Nested summary: ``returns_pct``, ``moving_averages`` and ``volatility`` structs.

    ``history_rows=100`` reproduces the compact (100-day) feed the application
    reads, where the 6-month and 1-year returns and the 200-day average never exist.
    """
    periods = kw.get("periods", tuple(p for p, _ in K.RETURN_PERIODS))
    windows = kw.get("windows", K.MA_WINDOWS)
    flat = price_metrics(prices, periods, windows, kw.get("window", K.VOLATILITY_WINDOW),
                         history_rows)
    ma_names = [c for w in windows for c in (f"ma_{w}", f"pct_from_ma_{w}")]
    return flat.select(
        "ticker", "price", "date", "volume",
        F.struct(*[return_label(p) for p in periods]).alias("returns_pct"),
        F.struct(*ma_names).alias("moving_averages"),
        F.struct("volatility_daily", "volatility_annual").alias("volatility"),
    )


def etf_summary(prices: DataFrame, etfs: DataFrame, history_rows: int | None = None) -> DataFrame:
    """Flat summary per fund; symbols that the list of ETFs lacks are flagged, not dropped."""
    s = price_metrics(prices, history_rows=history_rows)
    return s.join(etfs.select(F.col("symbol").alias("ticker"), F.lit(True).alias("known_etf")),
                  "ticker", "left").withColumn("known_etf", F.coalesce("known_etf", F.lit(False)))


# ---------------------------------------------------------------------------
# market correlation view
# ---------------------------------------------------------------------------

def market_correlation(prices: DataFrame, reits: DataFrame, rates: DataFrame) -> DataFrame:
    """Prices ⋈ REITs with as-of rates, previous close, daily return and 20/50-row averages.

    ``rates`` has one row per price date with ``fed_funds_rate``, ``treasury_10y``
    and ``treasury_2y`` (``operators.asof.asof_rates``).  Averages use partial
    frames at the start of a history; they are exact sums rounded half-up, taken
    as differences of running totals, so a row costs the same for every frame.
    Rates are broadcast: one row per date is bounded by the calendar.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    frames = (20, 50)
    p = prices.select("ticker", "date", "close", "volume", to_units("close").alias("_u"))
    running = p.select(
        "*", F.lag("close").over(w).alias("prev_close"), F.lag("_u").over(w).alias("_prev_u"), F.row_number().over(w).alias("_k"),
        F.coalesce(F.sum("_u").over(upto), F.lit(0).cast(WHOLE)).alias("_total"), F.count("_u").over(upto).alias("_known"))
    back = running.select("*", *[F.lag(c, n).over(w).alias(f"{c}_{n}") for n in frames for c in ("_total", "_known")])

    def ma(rows: int) -> Column:
        known = F.col("_known") - F.coalesce(f"_known_{rows}", F.lit(0))
        total = F.col("_total") - F.coalesce(f"_total_{rows}", F.lit(0).cast(WHOLE))
        return F.when(known > 0, from_units(round_div(total, F.least("_k", F.lit(rows)) * (UNITS // 100)), 2))

    u, prev_u = F.col("_u"), F.col("_prev_u")
    out = back.join(reits.select("ticker", "sector", "sub_sector"), "ticker").select(
        "ticker", "sector", "sub_sector", "date", F.col("close").alias("price"), "volume", "prev_close",
        F.when(prev_u > 0, ratio_round((u - prev_u) * 100, prev_u, 4)).alias("daily_return_pct"),
        *[ma(n).alias(f"ma_{n}") for n in frames],
    )
    out = out.join(F.broadcast(rates), "date", "left")
    return out.select(
        "ticker", "sector", "sub_sector", "date", "price", "volume",
        "fed_funds_rate", "treasury_10y", "treasury_2y", "prev_close", "daily_return_pct",
        "ma_20", "ma_50",
    ).orderBy(F.col("date").desc_nulls_last(), F.col("ticker").asc_nulls_last())
