"""Landed payload scans: missing macro values, error payloads, list limit before filter."""

import json

from pyspark.sql import functions as F

from reitlens.functions.aggs import exact_avg
from reitlens.operators.loaders import load_reits, with_load_seq
from reitlens.sources import dims, landed
from reitlens.sources.tables import lake_for


def js(spark, docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "json string")


def test_macro_json_drops_missing_marker(spark):
    docs = [{"series_id": "FEDFUNDS", "observations": [{"date": "2024-01-01", "value": "5.33"},
                                                      {"date": "2024-02-01", "value": "."},
                                                      {"date": "2024-03-01", "value": ""}]},
            {"series_id": "XYZ", "observations": [{"date": "2024-01-01", "value": "1.0"}]}]
    rows = landed.scan_macro_json(js(spark, docs), dims.series(spark)).collect()
    got = {(r["series_id"], str(r["date"])): (r["value"], r["name"], r["indicator_id"]) for r in rows}
    assert got == {("FEDFUNDS", "2024-01-01"): (5.33, "Federal Funds Effective Rate", "FEDFUNDS_20240101"),
                   ("XYZ", "2024-01-01"): (1.0, "XYZ", "XYZ_20240101")}


def test_price_json_errors_and_notes_yield_nothing(spark):
    bar = {"1. open": "10.0", "2. high": "11.0", "3. low": "9.5", "4. close": "10.5", "5. volume": "1000"}
    docs = [{"symbol": "O", "Time Series (Daily)": {"2024-01-02": bar, "2024-01-03": dict(bar, **{"4. close": "x"})}},
            {"symbol": "SPG", "Error Message": "Invalid API call"},
            {"symbol": "PLD", "Note": "Thank you for using the API"}]
    rows = landed.scan_price_json(js(spark, docs)).collect()
    assert [(r["ticker"], str(r["date"]), r["close"], r["volume"]) for r in rows] == [("O", "2024-01-02", 10.5, 1000)]


def test_filing_list_limit_counts_before_form_filter(spark):
    doc = {"cik": "1043604", "filings": {"recent": {
        "form": ["8-K", "10-K", "10-Q", "10-K"],
        "filingDate": ["2024-03-01", "2024-02-20", "2023-11-01", "2023-02-21"],
        "accessionNumber": ["a1", "a2", "a3", "a4"],
        "primaryDocument": ["d1", "d2", "d3", "d4"]}}}
    got = [r["accession_number"] for r in landed.scan_filing_list(js(spark, [doc]), "10-K", 3).collect()]
    assert got == ["a2"]
    assert landed.scan_filing_list(js(spark, [doc]), "10-K", 1).count() == 0


def test_filing_hits_window_and_form(spark):
    doc = {"ticker": "O", "hits": {"hits": [
        {"_source": {"form": "10-K", "file_date": "2024-02-20", "accession_no": "a1", "ticker": "O"}},
        {"_source": {"form": "8-K", "file_date": "2019-05-01", "accession_no": "a2", "ticker": "O"}}]}}
    got = landed.scan_filing_hits(js(spark, [doc]), form_type="10-K").collect()
    assert [r["accession_number"] for r in got] == ["a1"]


def test_cik_lookup(spark):
    t = spark.createDataFrame([(" avb ",), ("ZZZ",)], "ticker string")
    got = {r["ticker"]: r["cik"] for r in dims.lookup_cik(t, dims.cik_map(spark)).collect()}
    assert got == {" avb ": "0000763522", "ZZZ": None}


def test_read_documents_whole_text(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.htm").write_text("FFO per share was $4.05 for 2024\nsecond line\n", encoding="utf-8")
    (d / "b.htm").write_text("nothing", encoding="utf-8")
    got = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in landed.read_documents(spark, str(d)).collect()}
    assert got == {"a.htm": "FFO per share was $4.05 for 2024\nsecond line\n", "b.htm": "nothing"}


def filing_frame(spark):
    rows = [("7", "R1", f"2024-{m:02d}-{d:02d}", f"a{m:02d}{d:02d}", "10-K" if (m + d) % 2 else "8-K", "d.htm")
            for m in range(1, 7) for d in (3, 9, 21)]
    rows += [("8", "R2", "2023-05-05", "b1", "10-K", "d.htm")]
    cols = "cik string, reit_ticker string, d string, accession_number string, form_type string, primary_document string"
    return spark.createDataFrame(rows, cols).withColumn("filing_date", F.to_date("d")).drop("d")


def test_limits_count_over_all_pages_of_a_filer(spark):
    f = filing_frame(spark)
    pages = landed.submission_payloads(f)
    assert pages.count() == 7
    newest = sorted((r["accession_number"] for r in f.where("cik = '7'").collect()), reverse=True)
    got = {r["accession_number"]: r["pos"] for r in landed.scan_filing_list(pages, None, 5).where("cik = '7'").collect()}
    assert got == {a: i for i, a in enumerate(newest[:5])}
    tenk = [r["accession_number"] for r in landed.scan_filing_list(pages, "10-K", 5).where("cik = '7'").collect()]
    assert 0 < len(tenk) < 5 and set(tenk) < set(newest[:5])
    hits = landed.scan_filing_hits(landed.search_payloads(f), limit=4).where("reit_ticker = 'R1'").collect()
    assert sorted((r["accession_number"] for r in hits), reverse=True) == newest[:4]


def test_notes_and_missing_markers_take_no_real_rows(spark):
    v = spark.createDataFrame([("DGS2", "2024-07-31", 4.5), ("DGS2", "2024-08-31", 4.1)], "series_id string, d string, value double")
    v = v.withColumn("date", F.to_date("d")).drop("d")
    payloads = landed.macro_payloads(v)
    assert '"."' in payloads.first()["json"]
    assert {r["value"] for r in landed.scan_macro_json(payloads, dims.series(spark)).collect()} == {4.5, 4.1}
    p = spark.createDataFrame([("R1", "2024-01-02", 1.0, 2.0, 0.5, 1.5, 10)],
                              "ticker string, d string, open double, high double, low double, close double, volume long")
    notes = landed.price_payloads(p.withColumn("date", F.to_date("d")).drop("d"), landed.DAILY_KEY, "R1", 2024)
    assert notes.count() == 2 and notes.where("json like '%Note%'").count() == 1
    assert landed.scan_price_json(notes).count() == 1


def test_files_landed_later_are_seen(spark, tmp_path):
    path = f"{tmp_path}/orders.parquet"
    spark.range(3).write.parquet(path)
    assert lake_for(spark, str(tmp_path)).table("orders").count() == 3
    spark.range(2).write.mode("append").parquet(path)
    assert lake_for(spark, str(tmp_path)).table("orders").count() == 5


def test_averages_keep_more_than_four_decimals(spark):
    df = spark.createDataFrame([(1.00001,), (2.00002,), (None,)], "x double")
    assert df.agg(exact_avg("x").alias("m")).first()["m"] == 3.00003 / 2


def test_last_load_wins_by_the_given_position(spark):
    one = spark.createDataFrame([("O", 2, "later"), ("O", 1, "earlier")], "ticker string, line int, name string")
    got = load_reits(with_load_seq([one.repartition(2)], F.col("line"))).collect()
    assert [r["name"] for r in got] == ["later"]
