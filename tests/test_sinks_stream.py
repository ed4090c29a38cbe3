"""Writers are idempotent per partition; records round-trip; the landed-filings stream de-duplicates."""

import json
import os
import uuid

from pyspark.sql import functions as F

from reitlens import schemas
from reitlens.operators import quality as DQ
from reitlens.session import ensure_checkpoint_dir
from reitlens.sinks import writers as W
from reitlens.streaming.landed_filings import landed_filings_stream, run_available_now


def scratch(spark):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-{uuid.uuid4().hex}"


def test_signal_sink_rerun_is_idempotent(spark):
    path = scratch(spark)
    rows = spark.createDataFrame([("A_1", "A", "2024-06-28 12:00:00", 55.0)],
                                 "signal_id string, ticker string, generated_at string, composite_score double") \
        .withColumn("generated_at", F.col("generated_at").cast("timestamp"))
    W.sink_signals(rows, path)
    W.sink_signals(rows, path)
    assert spark.read.parquet(path).count() == 1


def test_records_round_trip_and_enum_check(spark):
    recs = spark.createDataFrame([(json.dumps({"ticker": "O", "name": "x", "sector": "Retail", "extra": 1}),),
                                  (json.dumps({"ticker": "Q", "name": "y", "sector": "Mortgage"}),)], "json string")
    parsed = W.from_records(recs, schemas.REITS, {"sector": ("Retail", "Office")})
    got = {r["ticker"]: r["dq_errors"] for r in parsed.collect()}
    assert got == {"O": [], "Q": ["'Mortgage' is not a valid sector"]}


def test_quality_split(spark):
    df = spark.createDataFrame([(" o ", "Retail", 0.5, 1.0), ("", "Retail", 2.5, -1.0)],
                               "ticker string, sector string, payout_ratio double, market_cap double")
    tagged = DQ.dq_reits(df)
    assert [r["ticker"] for r in DQ.valid(tagged).collect()] == ["O"]
    bad = DQ.quarantine(tagged).first()["dq_errors"]
    assert bad == ["REIT ticker must be non-empty", "Payout ratio 2.5 out of valid range [0, 2.0]",
                   "Market cap must be non-negative"]


def test_stream_picks_up_new_files_once(spark):
    root = scratch(spark)
    land, sink, ckpt = f"{root}/landing", f"{root}/sink", f"{root}/ckpt"
    b1 = [{"ticker": "o", "form": "10-K", "file_date": "2024-02-20", "accession_no": "a1"},
          {"ticker": "o", "form": "DEF 14A", "file_date": "2024-03-01", "accession_no": "a2"}]
    b2 = [{"ticker": "o", "form": "10-K", "file_date": "2024-02-20", "accession_no": "a1"},
          {"ticker": "spg", "form": "8-K", "file_date": "2024-04-01", "accession_no": "a3"}]
    for i, batch in enumerate((b1, b2)):
        os.makedirs(f"{land}/b{i}".replace("file:", ""), exist_ok=True)
        with open(f"{land}/b{i}/part.json".replace("file:", ""), "w") as fh:
            fh.write("\n".join(json.dumps(r) for r in batch))
        run_available_now(landed_filings_stream(spark, land), sink, ckpt)
    got = sorted((r["ticker"], r["accession"]) for r in spark.read.parquet(sink).collect())
    assert got == [("O", "a1"), ("SPG", "a3")]


def test_ingest_summary(spark):
    df = spark.createDataFrame([("A",), ("A",), ("B",)], "k string")
    got = {r["k"]: r["records"] for r in W.ingest_summary(df, "k", F.current_timestamp()).collect()}
    assert got == {"A": 2, "B": 1, "__total__": 3}


def test_raw_landing_zones_and_views(spark):
    root = scratch(spark)
    filings = spark.createDataFrame([("O", "10-K", "2024-02-20", "a1")],
                                    "ticker string, form_type string, filing_date string, accession string")
    W.sink_raw_filings(filings, f"{root}/filings")
    back = spark.read.json(f"{root}/filings").collect()
    assert [(r["ticker"], r["form_type"], r["accession"]) for r in back] == [("O", "10-K", "a1")]
    obs = spark.createDataFrame([("DGS10", "2024-01-02", 4.1)], "series_id string, date string, value double")
    W.sink_raw_macro(obs, f"{root}/macro", F.lit("2024-06-28"))
    W.sink_raw_macro(obs, f"{root}/macro", F.lit("2024-06-28"))
    assert spark.read.json(f"{root}/macro").count() == 1
    W.sink_views(spark, {"v_test_obs": obs}, f"{root}/views")
    assert spark.sql("SELECT count(*) AS n FROM v_test_obs").first()["n"] == 1


def test_to_records_cuts_text(spark):
    df = spark.createDataFrame([("x" * 600, "2024-01-02 03:04:05")], "extracted_text string, created_at string") \
        .withColumn("created_at", F.col("created_at").cast("timestamp"))
    rec = json.loads(W.filing_records(df).first()["json"])
    assert len(rec["extracted_text"]) == 500
    assert rec["created_at"] == "2024-01-02T03:04:05.000000"


def test_stream_reads_what_the_filing_sink_lands(spark, tmp_path):
    land, out, ckpt = (str(tmp_path / x) for x in ("land", "out", "ckpt"))
    rows = spark.createDataFrame([("O", "10-K", "2024-02-20", "a1"), ("O", "10-K", "2024-02-21", "a2"), ("O", "4", "2024-02-22", "a3")],
                                 "ticker string, form_type string, filing_date string, accession string")
    W.sink_raw_filings(rows, land)
    run_available_now(landed_filings_stream(spark, land), out, ckpt)
    got = sorted((r["ticker"], r["form_type"], str(r["filing_date"]), r["accession"]) for r in spark.read.parquet(out).collect())
    assert got == [("O", "10-K", "2024-02-20", "a1"), ("O", "10-K", "2024-02-21", "a2")]
