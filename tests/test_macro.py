"""Macro series: latest values, spread, trend, environment labels."""

import datetime as dt

import pytest

from reitlens.operators import macro as MA

SCHEMA = "series_id string, date date, value double"


def obs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def d(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=30 * i)


def test_latest_skips_missing_values(spark):
    df = obs(spark, [("FEDFUNDS", d(0), 5.0), ("FEDFUNDS", d(1), None), ("DGS10", d(0), 4.0)])
    got = {r["series_id"]: r["value"] for r in MA.latest_indicator(df).collect()}
    assert got == {"FEDFUNDS": 5.0, "DGS10": 4.0}


def test_spread_and_missing(spark):
    df = obs(spark, [("DGS10", d(0), 4.25), ("DGS2", d(0), 4.5), ("DGS2", d(1), 4.6)])
    assert MA.series_spread(df, "DGS10", "DGS2").first()["spread"] == -0.35
    assert MA.series_spread(df, "DGS10", "NOPE").first()["spread"] is None


@pytest.mark.parametrize("values,trend", [
    ([5.0, 5.0, 5.0], "Rising"),                       # older rows missing count as 0
    ([5.0, 5.0, 5.0, 5.0, 5.0, 5.0], "Stable"),
    ([5.2, 5.2, 5.2, 5.0, 5.0, 5.0], "Rising"),
    ([5.1, 5.1, 5.1, 5.0, 5.0, 5.0], "Stable"),          # exactly +0.1 is not above the band
    ([4.8, 4.8, 4.8, 5.0, 5.0, 5.0], "Falling"),
    ([5.0, 5.0], "Stable"),                             # fewer than 3 rows
    ([5.0, 5.0, 5.0, 5.0, 5.0], "Rising"),               # rows 4-5 only, still divided by 3
])
def test_rate_trend(spark, values, trend):
    # values are newest first
    rows = [("FEDFUNDS", d(10 - i), v) for i, v in enumerate(values)]
    assert MA.rate_trend(obs(spark, rows)).first()["rate_trend"] == trend


@pytest.mark.parametrize("fed,mort,t10,t2,rate,curve", [
    (2.0, 5.01, 4.0, 2.0, "Accommodative", "Normal"),
    (2.0, 5.0, 4.0, 3.6, "Neutral", "Flat"),
    (5.0, 6.49, 4.0, 4.1, "Restrictive", "Inverted"),
    (0.0, 7.0, 5.0, 2.99, "Neutral", "Steep"),
    (5.0, None, None, 2.0, "Neutral", "Normal"),
])
def test_rate_environment_labels(spark, fed, mort, t10, t2, rate, curve):
    rows = [(s, d(0), v) for s, v in (("FEDFUNDS", fed), ("WFII", mort), ("DGS10", t10), ("DGS2", t2))
            if v is not None]
    env = MA.rate_environment(obs(spark, rows)).first()
    assert (env["rate_assessment"], env["curve_assessment"]) == (rate, curve)


def test_relevant_series_window_and_limit(spark):
    rows = [("DGS10", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(120)]
    rows += [("MSPUS", dt.date(2024, 3, 1), 1.0)]
    got = MA.relevant_series(obs(spark, rows), dt.date(2024, 4, 29), lookback_months=2, limit=50).collect()
    assert len(got) == 50 and {r["series_id"] for r in got} == {"DGS10"}
    assert max(r["date"] for r in got) == dt.date(2024, 4, 29)
