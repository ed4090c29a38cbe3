"""Scans of landed JSON payloads (macro observations, price series, filing lists).

The application fetched these payloads over HTTP; here they are files (or
string columns) already landed, read with a fixed schema (no inference) and
flattened with ``explode`` / ``posexplode``.  Unparsable numbers are dropped with
``try_cast`` rather than failing the job.

``*_payloads`` functions build the same payload shapes from lake-derived
tables, so that the scans can be exercised at any scale: every payload groups
a bounded number of rows (one series-year, one ticker-year, or one month of one
filer), never a whole key.  A filer's list is a series of numbered pages, newest
first; a limit counts positions of the whole list, not of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reitlens import schemas
from reitlens.functions import scalars as S
from reitlens.sinks.writers import ingest_summary

# FIXED VALUES — names in the price and macro payloads
DAILY_KEY = "Time Series (Daily)"
WEEKLY_KEY = "Weekly Time Series"
BAR_FIELDS = (("open", "1. open"), ("high", "2. high"), ("low", "3. low"),
              ("close", "4. close"), ("volume", "5. volume"))
MISSING = "."


# ---------------------------------------------------------------------------
# readers for landed files
# ---------------------------------------------------------------------------

def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """Landed JSON documents (one per line) with a fixed schema."""
    return spark.read.schema(schema).json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole landed text documents, one row per file, with the file path."""
    return (spark.read.text(path, wholetext=True)
            .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path")))


# ---------------------------------------------------------------------------
# macro observations
# ---------------------------------------------------------------------------

def macro_payloads(values: DataFrame, missing_series: str = "DGS2", missing_month: int = 7) -> DataFrame:
    """One JSON document per (series, year); one month of one series also has a day landed as ``"."``."""
    real = F.struct(F.col("date").cast("string").alias("date"), F.col("value").cast("string").alias("value"))
    missing = F.struct(F.date_trunc("month", "date").cast("date").cast("string").alias("date"),
                       F.lit(MISSING).alias("value"))
    extra = (F.col("series_id") == missing_series) & (F.month("date") == missing_month)
    v = values.select("series_id", F.year("date").alias("y"),
                      F.explode(F.when(extra, F.array(real, missing)).otherwise(F.array(real))).alias("o"))
    g = v.groupBy("series_id", "y").agg(F.sort_array(F.collect_list("o"), asc=False).alias("observations"))
    return g.select(F.to_json(F.struct("series_id", "observations")).alias("json"))


def scan_macro_json(payloads: DataFrame, series_dim: DataFrame, json_col: str = "json") -> DataFrame:
    """Observation rows with a parsable value, with series metadata attached."""
    p = payloads.select(F.from_json(F.col(json_col), schemas.MACRO_PAYLOAD).alias("p"))
    obs = p.select(F.col("p.series_id").alias("series_id"),
                   F.explode("p.observations").alias("o"))
    rows = obs.select("series_id", F.col("o.date").try_cast("date").alias("date"),
                      F.col("o.value").try_cast("double").alias("value"))
    rows = rows.where(F.col("value").isNotNull() & F.col("date").isNotNull())
    meta = series_dim.select("series_id", "name", "unit", "frequency")
    j = rows.join(F.broadcast(meta), "series_id", "left")
    return j.select(
        S.indicator_id("series_id", "date").alias("indicator_id"), "series_id",
        F.coalesce("name", "series_id").alias("name"), "date", "value",
        F.coalesce("unit", F.lit("")).alias("unit"),
        F.coalesce("frequency", F.lit("")).alias("frequency"),
        F.lit("FRED").alias("source"))


# ---------------------------------------------------------------------------
# price series
# ---------------------------------------------------------------------------

def weekly_bars(prices: DataFrame) -> DataFrame:
    """Weekly OHLCV from daily rows; dated by the week's last trading day."""
    g = prices.groupBy("ticker", F.date_trunc("week", "date").alias("wk")).agg(
        F.max("date").alias("date"), F.min_by("open", "date").alias("open"),
        F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))
    return g.drop("wk")


def price_payloads(prices: DataFrame, key: str = DAILY_KEY, note_ticker: str | None = None,
                   note_year: int | None = None) -> DataFrame:
    """One JSON document per (ticker, year) keyed by date; optionally a rate-limit note beside one of them."""
    bar = F.create_map(*[x for name, label in BAR_FIELDS
                         for x in (F.lit(label), F.col(name).cast("string"))])
    v = prices.select("ticker", F.year("date").alias("y"),
                      F.struct(F.col("date").cast("string").alias("k"), bar.alias("v")).alias("e"))
    g = v.groupBy("ticker", "y").agg(F.map_from_entries(F.collect_list("e")).alias("series"))
    is_note = F.lit(False)
    if note_ticker is not None:
        is_note = (F.col("ticker") == note_ticker) & (F.col("y") == note_year)
    note = F.to_json(F.struct(F.col("ticker").alias("symbol"), F.lit("API call frequency exceeded").alias("Note")))
    doc = F.to_json(F.struct(F.col("ticker").alias("symbol"), F.col("series").alias(key)))
    return g.select(F.explode(F.when(is_note, F.array(doc, note)).otherwise(F.array(doc))).alias("json"))


def scan_price_json(payloads: DataFrame, key: str = DAILY_KEY, json_col: str = "json") -> DataFrame:
    """Rows (ticker, date, open, high, low, close, volume) from price payloads.

    Payloads carrying an error message or a rate-limit note yield no rows; a bar
    whose close does not parse is dropped.
    """
    p = payloads.select(F.from_json(F.col(json_col), schemas.PRICE_PAYLOAD).alias("p"))
    ok = p.where(F.col("p.`Error Message`").isNull() & F.col("p.Note").isNull())
    e = ok.select(F.col("p.symbol").alias("ticker"),
                  F.explode(F.col("p").getField(key)).alias("d", "bar"))
    cols = [F.col("bar").getItem(label).try_cast("double").alias(name)
            for name, label in BAR_FIELDS if name != "volume"]
    vol = F.col("bar").getItem("5. volume").try_cast("long").alias("volume")
    rows = e.select("ticker", F.col("d").try_cast("date").alias("date"), *cols, vol)
    return rows.where(F.col("close").isNotNull() & F.col("date").isNotNull())


CORRUPT = "_corrupt_record"


def price_summary_rows(payloads: DataFrame, run_ts: Column, key: str = DAILY_KEY, json_col: str = "json") -> DataFrame:
    """Summary of an ingestion run: bars and error per symbol, and in total.

    A payload that does not parse is kept by the reader's corrupt-record column
    and counts under a null symbol; an error message or a note is the error of
    its symbol.
    """
    schema = T.StructType([*schemas.PRICE_PAYLOAD.fields, T.StructField(CORRUPT, T.StringType())])
    p = payloads.select(F.from_json(F.col(json_col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("p"))
    corrupt = F.col(f"p.{CORRUPT}").isNotNull()
    error = F.coalesce(F.when(corrupt, "Corrupt payload"), F.col("p.`Error Message`"), F.col("p.Note"))
    bars = F.when(error.isNull(), F.coalesce(F.size(F.col("p").getField(key)), F.lit(0))).otherwise(0)
    rows = p.select(F.when(~corrupt, F.col("p.symbol")).alias("ticker"), bars.alias("bars"), error.alias("said"))
    return ingest_summary(rows, "ticker", run_ts, F.col("bars"), F.col("said"))


# ---------------------------------------------------------------------------
# filing lists (submissions) and search hits
# ---------------------------------------------------------------------------

def _page(day: Column) -> Column:
    """Page number of a filing date: one page a month, the newest month first."""
    return F.lit(12 * 10000) - F.year(day) * 12 - F.month(day)


def newest_positions(entries: DataFrame, key: str, limit: int) -> DataFrame:
    """Entries (key, page, pos, ...) at the first ``limit`` positions of each key's pages; ``pos`` is the place in the whole list.

    The rank filter lets every task keep ``limit`` rows per key before the shuffle,
    so a key with a third of all entries stays small.
    """
    order = Window.partitionBy(key).orderBy("page", "pos")
    ranked = entries.withColumn("at", F.row_number().over(order)).where(F.col("at") <= limit)
    return ranked.withColumn("pos", F.col("at") - 1).drop("at", "page")


def submission_payloads(filings: DataFrame) -> DataFrame:
    """Submission pages: one JSON document per filer and month, newest first."""
    e = F.struct("filing_date", "accession_number", "form_type", "primary_document")
    g = filings.groupBy("cik", _page(F.col("filing_date")).alias("page")).agg(
        F.sort_array(F.collect_list(e), asc=False).alias("fs"))
    recent = F.struct(
        F.transform("fs", lambda x: x["form_type"]).alias("form"),
        F.transform("fs", lambda x: x["filing_date"].cast("string")).alias("filingDate"),
        F.transform("fs", lambda x: x["accession_number"]).alias("accessionNumber"),
        F.transform("fs", lambda x: x["primary_document"]).alias("primaryDocument"))
    return g.select(F.to_json(F.struct("cik", "page", F.struct(recent.alias("recent")).alias("filings")))
                    .alias("json"))


def scan_filing_list(payloads: DataFrame, filing_type: str | None = "10-K", limit: int = 5,
                     json_col: str = "json") -> DataFrame:
    """Filing rows from submission payloads.

    ``limit`` counts positions in the filer's list (all its pages) *before* the
    form filter, as the application does.  A payload without ``page`` is a whole list.
    """
    p = payloads.select(F.from_json(F.col(json_col), schemas.SUBMISSIONS_PAYLOAD).alias("p"))
    r = F.col("p.filings.recent")
    z = p.select(F.col("p.cik").alias("cik"), F.col("p.page").alias("page"),
                 F.posexplode(F.arrays_zip(r["form"].alias("form"), r["filingDate"].alias("filingDate"),
                                           r["accessionNumber"].alias("accessionNumber"),
                                           r["primaryDocument"].alias("primaryDocument")))
                 .alias("pos", "f"))
    z = newest_positions(z, "cik", limit)
    if filing_type:
        z = z.where(F.col("f.form") == filing_type)
    return z.select("cik", "pos", F.col("f.form").alias("form"),
                    F.col("f.filingDate").alias("filing_date"),
                    F.col("f.accessionNumber").alias("accession_number"),
                    F.col("f.primaryDocument").alias("primary_document"))


def search_payloads(filings: DataFrame) -> DataFrame:
    """Search-hit pages: one JSON document per ticker and month, newest hits first."""
    src = F.struct(F.col("form_type").alias("form"), F.col("filing_date").cast("string").alias("file_date"),
                   F.col("accession_number").alias("accession_no"), F.col("reit_ticker").alias("ticker"))
    e = F.struct("filing_date", "accession_number", src.alias("_source"))
    g = filings.groupBy("reit_ticker", _page(F.col("filing_date")).alias("page")).agg(
        F.sort_array(F.collect_list(e), asc=False).alias("es"))
    g = g.withColumn("hits", F.transform("es", lambda x: F.struct(x["_source"].alias("_source"))))
    return g.select(F.to_json(F.struct(F.col("reit_ticker").alias("ticker"), "page",
                                       F.struct(F.col("hits").alias("hits")).alias("hits"))).alias("json"))


def scan_filing_hits(payloads: DataFrame, form_type: str | None = None,
                     start_date: str = "2020-01-01", end_date: str = "2025-12-31",
                     limit: int = 10, json_col: str = "json") -> DataFrame:
    """(ticker, form, filing date, accession): the first ``limit`` hits per ticker within a date window and form."""
    p = payloads.select(F.from_json(F.col(json_col), schemas.SEARCH_PAYLOAD).alias("p"))
    h = p.select(F.col("p.page").alias("page"), F.posexplode("p.hits.hits").alias("pos", "h"))
    s = h.select("page", "pos", F.col("h._source.ticker").alias("reit_ticker"),
                 F.col("h._source.form").alias("form_type"),
                 F.col("h._source.file_date").try_cast("date").alias("filing_date"),
                 F.col("h._source.accession_no").alias("accession_number"))
    s = s.where(F.col("filing_date").between(F.lit(start_date).cast("date"),
                                             F.lit(end_date).cast("date")))
    if form_type:
        s = s.where(F.col("form_type") == form_type)
    return newest_positions(s, "reit_ticker", limit).drop("pos")
