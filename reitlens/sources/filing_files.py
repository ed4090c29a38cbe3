"""Landed filing texts: one file per document, keyed by its path.

The layout is ``<root>/cik=<10 digits>/accession=<without dashes>/document=<name>/<file>``
(or the same three parts without their names, as a download mirror has them).
A scan reads whole files, takes the key from ``_metadata.file_path`` and reads
only the folders of the wanted filings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reitlens.functions import scalars as S
from reitlens.operators.fetch import KEY_BYTES, key_bytes

KEY = ("cik", "accession", "document")
#: Filers whose folders are named in the scan's partition filter; more are pruned by the join.
NAMED_FOLDERS = 1000
_PATH = r"/(?:cik=)?([^/]+)/(?:accession=)?([^/]+)/(?:document=)?([^/]+)/[^/]+$"


def keyed(filings: DataFrame) -> DataFrame:
    """``filings`` with the three parts of a document's path in place of their source columns."""
    rest = [c for c in filings.columns if c not in ("cik", "accession_number", "primary_document")]
    return filings.select(S.zero_pad("cik").alias("cik"), S.accession_clean("accession_number").alias("accession"), F.col("primary_document").alias("document"), *rest)


def land_texts(filings: DataFrame, root: str) -> None:
    """Write the texts that arrived (null and empty ones did not) as a file each."""
    texts = keyed(filings).where(F.coalesce(F.length("text"), F.lit(0)) > 0)
    texts.select("text", *KEY).write.mode("overwrite").partitionBy(*KEY).text(root)


def _from_path(part: int) -> Column:
    return F.try_url_decode(F.regexp_extract(F.col("_metadata.file_path"), _PATH, part))


def scan_filing_text(spark: SparkSession, root: str, wanted: DataFrame | None = None, end: str = "\n") -> DataFrame:
    """(cik, accession, document, text, ...): landed texts, of the filings in ``wanted`` only if given, with its other columns.

    ``end`` is what a text writer put behind the text (nothing for files kept as
    downloaded); the rest of the file is the text, line ends included.  A wanted
    filing without a file does not occur.
    """
    files = spark.read.schema("value string, cik string, accession string, document string").text(root, wholetext=True)
    if wanted is not None:
        few = [r[0] for r in wanted.select("cik").distinct().limit(NAMED_FOLDERS + 1).collect()]
        if len(few) <= NAMED_FOLDERS:
            files = files.where(F.col("cik").isin(*few))  # a partition filter: other folders are not opened
    body = F.col("value")
    if end:
        body = F.when(F.endswith(body, F.lit(end)), F.substr(body, F.lit(1), F.length(body) - len(end))).otherwise(body)
    texts = files.select(*[_from_path(i + 1).alias(k) for i, k in enumerate(KEY)], body.alias("text"), *[F.col(k).alias(f"folder_{k}") for k in KEY])
    if wanted is None:
        return texts.select(*KEY, "text")
    side = F.broadcast(wanted) if key_bytes(wanted, "document")[1] * 4 <= KEY_BYTES else wanted
    folders = [F.col(f"folder_{k}") == F.col(f"w_{k}") for k in KEY]
    named = side.select(*[F.col(k).alias(f"w_{k}") for k in KEY], *[c for c in wanted.columns if c not in KEY])
    return texts.join(named, folders).select(*KEY, "text", *[c for c in wanted.columns if c not in KEY])
