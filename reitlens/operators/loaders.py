"""Loading semantics of the in-memory stores, as set operations.

* REIT master: keyed by ticker, a later load replaces an earlier one.
* Metrics: kept per ticker, newest (fiscal_year, quarter) first; rows with the
  same key keep their load order (a stable sort), so the first loaded wins.

Both are expressed with an explicit ``load_seq`` column (batch number, then
row position) instead of relying on physical order, which Spark never
guarantees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reitlens.functions import scalars as S


def with_load_seq(batches: Sequence[DataFrame], position: Column) -> DataFrame:
    """Union of load batches with ``load_seq`` = (batch index, position in the batch).

    ``position`` is a column of the source that orders the rows of a batch (a line
    number, an offset, a load time): Spark keeps no file order to count by.
    """
    out = None
    for i, b in enumerate(batches):
        tagged = b.withColumn("load_seq", F.struct(F.lit(i).alias("batch"), position.alias("pos")))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def load_reits(loaded: DataFrame) -> DataFrame:
    """Upsert by normalised ticker, last load wins (needs ``load_seq``).

    A ``max_by`` aggregate keyed by the load sequence: partially aggregated, so
    repeated loads of one ticker never pile up in one task.
    """
    t = loaded.withColumn("ticker", S.norm_ticker("ticker"))
    row = F.struct(*[F.col(c) for c in t.columns if c != "load_seq"])
    return t.groupBy("ticker").agg(F.max_by(row, "load_seq").alias("_r")).select("_r.*")


def load_metrics(loaded: DataFrame) -> DataFrame:
    """Normalise tickers; keep ``load_seq`` so latest-row picks honour load order."""
    return loaded.withColumn("reit_ticker", S.norm_ticker("reit_ticker"))
