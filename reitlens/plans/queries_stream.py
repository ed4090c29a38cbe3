"""Registered streaming query: incremental, de-duplicated pick-up of landed filings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reitlens.plans.oracle import with_tables
from reitlens.plans.queries_text import RUN_DATE
from reitlens.plans.registry import query
from reitlens.session import ensure_checkpoint_dir
from reitlens.sources import bind
from reitlens.sources.tables import lake_for
from reitlens.streaming.landed_filings import landed_filings_stream, run_available_now


@query("stream_landed_filings", oracle=with_tables("""
SELECT upper(trim(reit_ticker)) AS ticker, form_type, filing_date, accession_number AS accession
FROM filings WHERE form_type IN ('10-K', '10-Q', '8-K')""", "filings"))
def q_stream_landed_filings(spark, sf_dir):
    """Two landing batches (the second repeats filings of the first) picked up by two runs, without a state store."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/landed-filings-{uuid.uuid4().hex}"
    f = bind.filings(lake_for(spark, sf_dir)).drop("text")
    rec = f.select(F.col("reit_ticker").alias("ticker"), F.col("form_type").alias("form"),
                   F.col("filing_date").cast("string").alias("file_date"),
                   F.col("accession_number").alias("accession_no"), "filing_date")
    first = rec.where(F.col("filing_date") < F.lit(RUN_DATE)).drop("filing_date")
    second = rec.where(F.col("filing_date") >= F.lit(RUN_DATE - (RUN_DATE - RUN_DATE.replace(month=1, day=1))))
    second = second.drop("filing_date")
    stream_sink, ckpt = f"{root}/sink", f"{root}/checkpoint"
    first.write.mode("overwrite").json(f"{root}/landing/batch=1")
    run_available_now(landed_filings_stream(spark, f"{root}/landing"), stream_sink, ckpt)
    second.write.mode("overwrite").json(f"{root}/landing/batch=2")
    run_available_now(landed_filings_stream(spark, f"{root}/landing"), stream_sink, ckpt)
    return spark.read.parquet(stream_sink).select("ticker", "form_type", "filing_date", "accession")
