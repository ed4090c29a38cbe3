"""Small fixed dimensions (seed REITs, macro series, CIKs, ETFs).

Their cardinality is fixed by the application (12, 11, 12 and 4 rows), so they
are the only frames built from literals and the only ones always broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reitlens import constants as K
from reitlens import schemas


def seed_reits(spark: SparkSession) -> DataFrame:
    rows = [r + (None, None) for r in K.SEED_REITS]
    return spark.createDataFrame(rows, schemas.REITS)


def series(spark: SparkSession) -> DataFrame:
    rel = set(K.RELEVANT_SERIES)
    rows = [(sid, name, freq, unit, sid in rel) for sid, name, freq, unit in K.SERIES]
    schema = T.StructType([
        T.StructField("series_id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("frequency", T.StringType(), False),
        T.StructField("unit", T.StringType(), False),
        T.StructField("reit_relevant", T.BooleanType(), False),
    ])
    return spark.createDataFrame(rows, schema)


def cik_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.CIK_BY_TICKER), "ticker string, cik string")


def etfs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.REIT_ETFS), "symbol string, name string")


def lookup_cik(tickers: DataFrame, ciks: DataFrame, column: str = "ticker") -> DataFrame:
    """Left join on the normalised ticker; unknown tickers get a NULL CIK."""
    from reitlens.functions.scalars import norm_ticker
    probe = tickers.withColumn("_t", norm_ticker(column))
    return (probe.join(F.broadcast(ciks.withColumnRenamed("ticker", "_t")), "_t", "left")
            .drop("_t"))
