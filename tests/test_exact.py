"""Exact integer helpers against Python's fractions (property-based)."""

from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reitlens.functions.exact import combine_split, intdiv, ratio_round, round_div, split_sum

INTS = st.integers(min_value=-10 ** 12, max_value=10 ** 12)


def half_away(q: Fraction) -> int:
    n = abs(q) + Fraction(1, 2)
    r = n.numerator // n.denominator
    return r if q >= 0 else -r


def trunc(q: Fraction) -> int:
    r = abs(q.numerator) // q.denominator
    return r if q >= 0 else -r


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(INTS, INTS), min_size=1, max_size=40))
def test_intdiv_and_round_div(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select("a", "b", intdiv(F.col("a"), F.col("b")).alias("q"),
                    round_div(F.col("a"), F.col("b")).alias("r"),
                    ratio_round(F.col("a"), F.col("b"), 2).alias("x")).collect()
    for row in got:
        a, b = row["a"], row["b"]
        if b == 0:
            assert (row["q"], row["r"], row["x"]) == (None, None, None)
            continue
        q = Fraction(a, b)
        assert row["q"] == trunc(q)
        assert row["r"] == half_away(q)
        assert row["x"] == half_away(q * 100) / 100


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=2 ** 40), min_size=1, max_size=60))
def test_split_sum_is_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    hi, lo = split_sum(F.col("v"))
    got = df.agg(combine_split(hi, lo).alias("s")).first()["s"]
    assert int(got) == sum(values)


def test_wide_prices_equal_exact_fractions(spark):
    """Six decimals, a price of 0.00004 and large prices: returns and averages equal the exact fractions, rounded half away from zero."""
    from decimal import ROUND_HALF_UP, Decimal
    from fractions import Fraction

    from reitlens.operators import prices as PR

    series = {"SIX": [10.000001 + i * 0.123457 for i in range(260)], "TINY": [0.00004 + (i % 7) * 0.00001 for i in range(260)],
              "BIG": [98765432.1234 - i * 12345.678 for i in range(260)]}
    rows = [(t, f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", float(f"{p:.6f}"), 1) for t, ps in series.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "ticker string, date string, close double, volume long").withColumn("date", __import__("pyspark.sql.functions", fromlist=["f"]).to_date("date"))

    def rounded(x: Fraction, places: int) -> float:
        q = Decimal(x.numerator) / Decimal(x.denominator) if x.denominator < 10 ** 20 else Decimal(0)
        scaled = x * 10 ** places
        whole = (abs(scaled.numerator) * 2 + scaled.denominator) // (2 * scaled.denominator)
        assert abs(q) < Decimal(10) ** 20 and ROUND_HALF_UP
        return float(Fraction(whole if scaled >= 0 else -whole, 10 ** places))

    got = {r["ticker"]: r for r in PR.price_metrics(df).collect()}
    for t in series:
        newest = [Fraction(str(p)) for _, d, p, _ in sorted((r for r in rows if r[0] == t), key=lambda r: r[1], reverse=True)]
        for n, label in PR.STANDARD_LABELS.items():
            if len(newest) > n:
                assert got[t][f"return_{label}"] == rounded((newest[0] - newest[n]) / newest[n] * 100, 2), (t, n)
        for w in (20, 50, 200):
            mean = sum(newest[:w]) / w
            assert got[t][f"ma_{w}"] == rounded(mean, 2)
            assert got[t][f"pct_from_ma_{w}"] == rounded((newest[0] - mean) / mean * 100, 2)
