"""Price analytics against straightforward Python computations on generated series."""

import datetime as dt
import math
import random

import pytest

from reitlens.operators import prices as PR
from reitlens.operators.asof import asof_values


def series(n, seed=7, start=100.0):
    rnd = random.Random(seed)
    out, p = [], start
    d0 = dt.date(2023, 1, 2)
    for i in range(n):
        p = max(1.0, p * (1 + rnd.uniform(-0.03, 0.03)))
        out.append((d0 + dt.timedelta(days=i), round(p, 4)))
    return out  # oldest first


def frame(spark, data):
    rows = [("T", d, c, c, c, c, 1000 + i) for i, (d, c) in enumerate(data)]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, "
                                       "close double, volume long")


def py_half_up(x, nd):
    from decimal import ROUND_HALF_UP, Decimal
    return float(Decimal(x).quantize(Decimal(1).scaleb(-nd), rounding=ROUND_HALF_UP))


def _half_up_int(q):
    from fractions import Fraction
    n = abs(q) + Fraction(1, 2)
    r = n.numerator // n.denominator
    return r if q >= 0 else -r


def ref_returns(closes_new_first, periods):
    from fractions import Fraction
    out = {}
    if len(closes_new_first) < 2:
        return out
    cur = Fraction(str(closes_new_first[0]))
    for p in periods:
        if len(closes_new_first) > p:
            past = Fraction(str(closes_new_first[p]))
            out[PR.return_label(p)] = _half_up_int((cur - past) / past * 100 * 100) / 100
    return out


@pytest.mark.parametrize("n", [0, 1, 20, 21, 63, 64, 199, 200, 252, 253, 260])
def test_returns_mas_volatility_vs_python(spark, n):
    from fractions import Fraction
    data = series(n)
    if n == 0:
        df = frame(spark, [])
        assert PR.price_metrics(df).count() == 0
        return
    got = PR.price_metrics(frame(spark, data)).first().asDict()
    closes = [c for _, c in reversed(data)]  # newest first
    exp = ref_returns(closes, [21, 63, 126, 252])
    for p in (21, 63, 126, 252):
        assert got[PR.return_label(p)] == exp.get(PR.return_label(p))
    for w in (20, 50, 200):
        if n >= w:
            s = sum(Fraction(str(c)) for c in closes[:w])
            assert got[f"ma_{w}"] == _half_up_int(s / w * 100) / 100
            cur = Fraction(str(closes[0]))
            assert got[f"pct_from_ma_{w}"] == _half_up_int((cur - s / w) / (s / w) * 100 * 100) / 100
        else:
            assert got[f"ma_{w}"] is None and got[f"pct_from_ma_{w}"] is None
    if n < 21:
        assert (got["volatility_daily"], got["volatility_annual"]) == (0.0, 0.0)
    else:
        rets = [(closes[i] - closes[i + 1]) / closes[i + 1] for i in range(len(closes) - 1)][:20]
        avg = sum(rets) / len(rets)
        sd = math.sqrt(sum((r - avg) ** 2 for r in rets) / len(rets))
        assert got["volatility_daily"] == pytest.approx(round(sd * 100, 4), abs=1e-4)
        assert got["volatility_annual"] == pytest.approx(round(sd * math.sqrt(252) * 100, 2), abs=1e-2)
    assert got["price"] == closes[0]


def test_compact_history_hides_long_horizons(spark):
    got = PR.price_metrics(frame(spark, series(260)), history_rows=100).first()
    assert got["return_3m"] is not None
    assert got["return_6m"] is None and got["return_1y"] is None and got["ma_200"] is None


def test_custom_period_label(spark):
    got = PR.period_returns(frame(spark, series(30)), periods=(5,)).first()
    assert "return_5d" in got.asDict()


def test_price_summary_structs(spark):
    s = PR.price_summary(frame(spark, series(30))).first()
    assert set(s["returns_pct"].asDict()) == {"return_1m", "return_3m", "return_6m", "return_1y"}
    assert s["volatility"]["volatility_daily"] > 0


def test_market_correlation_partial_frames_and_nulls(spark):
    data = series(25)
    df = frame(spark, data)
    reits = spark.createDataFrame([("T", "Retail", "Mall")], "ticker string, sector string, sub_sector string")
    rates = spark.createDataFrame([], "date date, fed_funds_rate double, treasury_10y double, treasury_2y double")
    out = {r["date"]: r for r in PR.market_correlation(df, reits, rates).collect()}
    first = out[data[0][0]]
    assert first["prev_close"] is None and first["daily_return_pct"] is None
    assert first["ma_20"] == py_half_up(data[0][1], 2)
    second = out[data[1][0]]
    assert second["ma_20"] == _half_up_int((__import__("fractions").Fraction(str(data[0][1]))
                                            + __import__("fractions").Fraction(str(data[1][1]))) / 2 * 100) / 100


def test_market_correlation_averages_cost_the_same_for_every_frame(spark):
    from fractions import Fraction

    from tests.test_late_fetch import explained
    data = series(130)
    rows = [("T", d, None if 30 <= i < 85 else c, 1) for i, (d, c) in enumerate(data)]  # more missing closes than a frame holds
    df = spark.createDataFrame(rows, "ticker string, date date, close double, volume long")
    reits = spark.createDataFrame([("T", "Retail", "Mall")], "ticker string, sector string, sub_sector string")
    rates = spark.createDataFrame([(data[0][0], 1.0, 2.0, 3.0)], "date date, fed_funds_rate double, treasury_10y double, treasury_2y double")
    view = PR.market_correlation(df, reits, rates)
    assert "specifiedwindowframe(RowFrame, -19" not in explained(view) and "specifiedwindowframe(RowFrame, -49" not in explained(view)
    out = sorted(view.collect(), key=lambda r: r["date"])
    for i, r in enumerate(out):
        for n in (20, 50):
            frame_rows = [c for _, _, c, _ in rows[max(0, i - n + 1):i + 1]]
            known = [Fraction(str(c)) for c in frame_rows if c is not None]
            assert r[f"ma_{n}"] == (_half_up_int(sum(known) / len(frame_rows) * 100) / 100 if known else None), (i, n)
        assert r["prev_close"] == (rows[i - 1][2] if i else None)


def test_asof_before_on_and_between_observations(spark):
    obs = spark.createDataFrame([("S", dt.date(2024, 1, 10), 1.0), ("S", dt.date(2024, 1, 20), 2.0),
                                 ("S", dt.date(2024, 1, 20), 2.5), ("S", dt.date(2024, 1, 25), None)],
                                "series_id string, date date, value double")
    dates = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (5, 10, 15, 20, 26)], "date date")
    got = {r["date"].day: r["v"] for r in asof_values(dates, obs, ["S"], ["v"]).collect()}
    assert got == {5: None, 10: 1.0, 15: 1.0, 20: 2.5, 26: 2.5}
