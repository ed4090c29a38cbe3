import pytest
from pyspark.sql import functions as F

from reitlens.functions import scalars as S
from reitlens.functions.text import py_fixed, py_percent0, py_round


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(f"{n} {t}" for n, (_, t) in
                                                                          zip(names, [(v, _type(v)) for v in cols.values()])))
    return df.select(expr.alias("x")).first()["x"]


def _type(v):
    return {float: "double", int: "long", str: "string"}.get(type(v), "string")


def col1(spark, values, typ, fn):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r["x"] for r in df.select(fn(F.col("v")).alias("x")).collect()]


def test_norm_ticker_strips_unicode_space_and_uppercases(spark):
    got = col1(spark, [" o ", "\tpld\n", " spg ", "", None], "string", S.norm_ticker)
    assert got == ["O", "PLD", "SPG", "", None]


@pytest.mark.parametrize("lev,rating", [(3.0, "A"), (3.0001, "B"), (5.0, "B"), (7.0, "C"), (7.01, "D"), (None, "D")])
def test_leverage_rating_edges(spark, lev, rating):
    assert col1(spark, [lev], "double", S.leverage_rating) == [rating]


@pytest.mark.parametrize("div,affo,sql_band,model_band", [
    (0.60, 1.0, "Very Safe", "Very Safe"), (0.61, 1.0, "Safe", "Safe"), (0.75, 1.0, "Safe", "Safe"),
    (0.85, 1.0, "Moderate", "Moderate"), (0.95, 1.0, "Risky", "Risky"), (0.96, 1.0, "Unsafe", "Unsafe"),
    (1.0, 0.0, "Unsafe", "Very Safe"), (1.0, -2.0, "Unsafe", "Very Safe"),
])
def test_dividend_safety_sql_and_model(spark, div, affo, sql_band, model_band):
    df = spark.createDataFrame([(div, affo)], "d double, a double")
    r = df.select(S.dividend_safety_sql("d", "a").alias("s"), S.dividend_safety_model("d", "a").alias("m")).first()
    assert (r["s"], r["m"]) == (sql_band, model_band)


def test_payout_ratio_variants(spark):
    df = spark.createDataFrame([(1.2, 1.6), (1.0, 0.0), (1.0, -1.0), (1.0, 3.0)], "d double, a double")
    r = df.select(S.payout_ratio_sql("d", "a").alias("s"), S.payout_ratio_model("d", "a").alias("m")).collect()
    assert [x["s"] for x in r] == [0.75, None, None, 0.3333]
    assert [x["m"] for x in r] == [1.2 / 1.6, 0.0, 0.0, 1.0 / 3.0]


def test_ids_and_urls(spark):
    df = spark.createDataFrame([("O", "10-K", "2024-02-20", "1043604", "0001043604-24-000012", "o-2023.htm",
                                 "DEF 14A")],
                               "t string, f string, d string, cik string, acc string, doc string, f2 string")
    r = df.select(S.filing_id("t", "f", "d").alias("fid"), S.filing_id("t", "f2", "d").alias("fid2"),
                  S.zero_pad("cik").alias("pad"), S.document_url("cik", "acc", "doc").alias("url"),
                  S.indicator_id(F.lit("DGS10"), F.lit("2024-01-02")).alias("iid")).first()
    assert r["fid"] == "O_10K_20240220"
    assert r["fid2"] == "O_DEF_14A_20240220"
    assert r["pad"] == "0001043604"
    assert r["url"] == "https://data.sec.gov/Archives/edgar/data/0001043604/000104360424000012/o-2023.htm"
    assert r["iid"] == "DGS10_20240102"


def test_zero_pad_keeps_long_input_whole(spark):
    assert col1(spark, ["12345678901", "7"], "string", S.zero_pad) == ["12345678901", "0000000007"]


def test_signal_id(spark):
    df = spark.createDataFrame([("O",), ("",)], "t string")
    got = [r["x"] for r in df.select(S.signal_id("t", F.lit("2024-06-28 12:34:56").cast("timestamp")).alias("x")).collect()]
    assert got == ["O_20240628_123456", "signal_20240628_123456"]


def test_metric_lookup_defaults(spark):
    df = spark.createDataFrame([({"a": 1.5},), ({},)], "m map<string,double>")
    got = [(r["x"], r["y"]) for r in df.select(S.metric_lookup("m", "a", 9.0).alias("x"),
                                               S.metric_lookup("m", "b").alias("y")).collect()]
    assert got == [(1.5, None), (9.0, None)]


@pytest.mark.parametrize("x,d", [(2.675, 2), (0.125, 2), (62.5, 0), (52.25, 1), (6.35, 1), (1234.5, 1), (-1.25, 1),
                                 (0.1 + 0.2, 2), (1e9 / 3, 1)])
def test_python_style_formatting(spark, x, d):
    df = spark.createDataFrame([(x,)], "v double")
    r = df.select(py_fixed(F.col("v"), d).alias("s"), py_round(F.col("v"), d).alias("r")).first()
    assert r["s"] == f"{x:.{d}f}"
    assert r["r"] == round(x, d)


def test_percent_format(spark):
    df = spark.createDataFrame([(0.76,), (0.625,), (0.0,)], "v double")
    assert [r["p"] for r in df.select(py_percent0(F.col("v")).alias("p")).collect()] == \
        [f"{0.76:.0%}", f"{0.625:.0%}", f"{0.0:.0%}"]


def test_property_values(spark):
    df = spark.createDataFrame([(1000.0, 20.0, 0.9, 0.05, 100.0, 130.0), (10.0, 1.0, 1.0, 0.0, 0.0, 5.0)],
                               "sqft double, psf double, occ double, cap double, cost double, book double")
    noi = S.noi_estimate("sqft", "psf", "occ")
    r = df.select(S.annual_rent("sqft", "psf").alias("rent"), noi.alias("noi"),
                  S.value_at_cap(noi, "cap").alias("val"), S.appreciation("cost", "book").alias("app")).collect()
    assert r[0]["rent"] == 20000.0
    assert r[0]["noi"] == pytest.approx(20000.0 * 0.9 * 0.65)
    assert r[0]["val"] == pytest.approx(20000.0 * 0.9 * 0.65 / 0.05)
    assert r[0]["app"] == pytest.approx(0.3)
    assert (r[1]["val"], r[1]["app"]) == (0.0, 0.0)


def test_reit_master_derived_values(spark):
    df = spark.createDataFrame([(45e9, 4.05, 0.76), (0.0, 4.0, 0.5), (10.0, 0.0, 0.5)], "cap double, ffo double, p double")
    r = df.select(S.annual_dividend("ffo", "p").alias("div"), S.ffo_yield_master("cap", "ffo", "p").alias("fy")).collect()
    assert r[0]["div"] == pytest.approx(4.05 * 0.76)
    shares = 45e9 / 4.05 * 0.76
    assert r[0]["fy"] == 4.05 / (45e9 / shares)
    assert (r[1]["fy"], r[2]["div"], r[2]["fy"]) == (0.0, 0.0, 0.0)
