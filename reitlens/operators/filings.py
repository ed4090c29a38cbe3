"""Filing text → metrics, filing ingestion and new-filing detection.

Extraction is a projection over whole document texts (JVM regex, no UDF), so
it parallelises with the scan.  Picking the newest filing per filer is a
``max_by`` aggregate (partial aggregation: a filer with a third of all filings
still only ships one candidate per task); the document text is fetched late,
for the chosen filings only, and is measured and parsed where it is read
(``operators.fetch``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reitlens import constants as K
from reitlens.functions import scalars as S
from reitlens.functions.text import METRIC_KEYS, extract_financials, extract_metric
from reitlens.operators.fetch import late_fetch


def extract_filing_metrics(filings: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per document with the six extracted figures (NULL when not found)."""
    t = F.col(text_col)
    return filings.select("doc_id", *[extract_metric(t, k).alias(k) for k in METRIC_KEYS])


def newest_filing(filings: DataFrame, by: str = "cik") -> DataFrame:
    """Newest filing (by filing date, then accession) per ``by`` key, text excluded."""
    meta = ["doc_id", "reit_ticker", "cik", "form_type", "filing_date", "accession_number",
            "primary_document"]
    key = F.struct("filing_date", "accession_number")
    top = F.max_by(F.struct(*meta), key)
    return filings.groupBy(by).agg(top.alias("f")).select("f.*")


def ingest_filings(filings: DataFrame, form_type: str, processed_at: Column) -> DataFrame:
    """The application's ingest step for every filer at once.

    The filer's filing list is read with ``limit=1`` *before* the form filter,
    so a filer is ingested only when its newest filing has the requested form.
    The text is downloaded (here: fetched late), kept to 8,000 characters,
    measured in characters and parsed in full; an empty or missing text marks
    the filing ``Failed``.
    """
    latest = newest_filing(filings).where(F.col("form_type") == F.lit(form_type))
    text = F.col("text")
    wanted = [S.excerpt(text, K.FILING_TEXT_KEEP).alias("excerpt"), extract_financials(text).alias("figures"), F.char_length(text).cast("long").alias("chars")]
    j = late_fetch(latest, filings.select("doc_id", "text"), "doc_id", wanted)
    ok = F.coalesce(F.col("chars") > 0, F.lit(False))
    url = S.document_url("cik", "accession_number", "primary_document")
    return j.select(
        S.filing_id("reit_ticker", "form_type", "filing_date").alias("filing_id"),
        S.norm_ticker("reit_ticker").alias("reit_ticker"),
        "cik", "form_type", "filing_date",
        F.lit(None).cast("date").alias("period_ending"),
        F.when(ok, url).otherwise(F.lit("")).alias("document_url"),
        F.when(ok, F.col("excerpt")).otherwise(F.lit("")).alias("extracted_text"),
        F.when(ok, F.col("figures")).alias("key_metrics_extracted"),
        F.when(ok, "Parsed").otherwise("Failed").alias("status"),
        F.when(ok, "").otherwise("Failed to download filing document").alias("error_message"),
        F.when(ok, F.col("chars")).otherwise(F.lit(0)).cast("long").alias("file_size_bytes"),
        F.when(ok, processed_at).alias("processed_at"),
    )


def detect_new_filings(hits: DataFrame, landed: DataFrame, run_date, days: int = 1) -> DataFrame:
    """Filings of a watched form from the last ``days`` days up to ``run_date`` that are not landed yet.

    ``hits``: (reit_ticker, form_type, filing_date, accession_number);
    ``landed``: accession numbers already written.  The landing key contains the
    accession, so re-running the same day lands nothing twice.
    """
    today = hits.where(F.col("filing_date").between(F.lit(run_date - dt.timedelta(days=days - 1)), F.lit(run_date))
                       & F.col("form_type").isin(*K.WATCHED_FORMS))
    new = today.join(landed.select("accession_number"), "accession_number", "left_anti")
    return new.select(
        F.col("reit_ticker").alias("ticker"), "form_type", "filing_date",
        F.col("accession_number").alias("accession"),
        F.concat_ws("/", F.lit("sec_filings/raw"), "reit_ticker", "form_type",
                    F.concat(F.col("accession_number"), F.lit(".json"))).alias("landing_key"),
    )
