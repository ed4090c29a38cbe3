"""Incremental pick-up of newly landed filing records (Structured Streaming).

The application lands one JSON record per filing under
``…/<ticker>/<form>/<accession>.json`` on a daily schedule.  This stream reads
that folder with a fixed schema, keeps the watched forms, drops accessions it
has already emitted and appends the rest to a sink.  ``trigger(availableNow)``
processes everything landed so far and stops, which is how a scheduled batch
runs a stream; the checkpoint under the shared ``spark.checkpoint.dir`` makes
it exactly-once across restarts and lost executors.

The stream keeps no state.  Each micro-batch is appended by key to a sink that
is partitioned by filing month, and compared with the months that it touches
only, so a filing that arrives late or again is told from a new one however old
it is.  (A watermark would bound a state store too, but would drop late filings.)
The micro-batch's number names its manifest, so one that is run again after a
failure adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from reitlens import constants as K
from reitlens.functions.scalars import norm_ticker
from reitlens.sinks.writers import append_new

LANDED_FILING = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("form", T.StringType()),
    T.StructField("file_date", T.StringType()),
    T.StructField("accession_no", T.StringType()),
    T.StructField("filing_date", T.StringType()),
    T.StructField("accession", T.StringType()),
])


def _from_path(key: str) -> Column:
    """Value of a partition folder ``key=value`` in the file's path; NULL without one."""
    value = F.regexp_extract(F.col("_metadata.file_path"), f"/{key}=([^/]+)/", 1)
    return F.when(value != "", F.try_url_decode(value))


def landed_filings_stream(spark: SparkSession, landing_dir: str) -> DataFrame:
    """New filings of the watched forms: source records, or records as ``sink_raw_filings`` lands them."""
    raw = (spark.readStream.schema(LANDED_FILING).option("recursiveFileLookup", "true")
           .json(landing_dir))
    rows = raw.select(
        norm_ticker(F.coalesce("ticker", _from_path("ticker"))).alias("ticker"),
        F.coalesce("form", _from_path("form_type")).alias("form_type"),
        F.coalesce("file_date", "filing_date").try_cast("date").alias("filing_date"),
        F.coalesce("accession_no", "accession").alias("accession"))
    return rows.where(F.col("form_type").isin(*K.WATCHED_FORMS))


def append_batch(sink_dir: str):
    """The function of a micro-batch: append its new accessions, partitioned by filing month."""
    def append(batch: DataFrame, number: int) -> None:
        month = F.coalesce(F.date_format("filing_date", "yyyy-MM"), F.lit("none"))
        append_new(batch.withColumn("filing_month", month), sink_dir, ["filing_month"], ["filing_month", "accession"], batch=f"stream-{number}")
    return append


def run_available_now(stream: DataFrame, sink_dir: str, checkpoint_dir: str) -> StreamingQuery:
    """Append everything available now to Parquet and stop."""
    q = (stream.writeStream.foreachBatch(append_batch(sink_dir))
         .option("checkpointLocation", checkpoint_dir).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
