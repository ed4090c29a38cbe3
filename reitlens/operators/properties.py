"""Property portfolio roll-ups and per-property value estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reitlens.functions import scalars as S
from reitlens.functions.aggs import exact_avg


def max_msa_count(properties: DataFrame) -> DataFrame:
    """Largest number of properties in one MSA per REIT, over all statuses.

    A NULL MSA is a group of its own, as in ``GROUP BY msa``.  Two partial
    aggregations: (ticker, msa) counts, then the max per ticker.
    """
    per_msa = properties.groupBy("reit_ticker", "msa").agg(F.count(F.lit(1)).alias("cnt"))
    return per_msa.groupBy("reit_ticker").agg(F.max("cnt").alias("max_msa_concentration"))


def property_analysis(reits: DataFrame, properties: DataFrame) -> DataFrame:
    """Operating-property roll-up per REIT, ordered by sector then total sqft descending.

    The view's LEFT JOIN is followed by ``status = 'Operating'``, which rejects the
    padded rows, so it is an inner join with the filter pushed to the scan side.
    """
    op = properties.where(F.col("status") == "Operating")
    r = reits.select("ticker", "name", "sector")
    j = r.join(op.drop("name"), r.ticker == op.reit_ticker, "inner")
    occ = F.col("occupancy_rate")
    g = j.groupBy("ticker", "name", "sector").agg(
        F.count(F.lit(1)).alias("total_properties"),
        F.sum("sqft").alias("total_sqft"),
        exact_avg("occupancy_rate").alias("avg_occupancy_rate"),
        exact_avg("annual_rent_psf").alias("avg_rent_psf"),
        exact_avg("cap_rate").alias("avg_cap_rate"),
        exact_avg("lease_expiry_weighted_avg").alias("avg_lease_expiry_years"),
        F.sum(F.when(occ >= 0.95, 1).otherwise(0)).cast("long").alias("high_occupancy_count"),
        F.sum(F.when(occ < 0.85, 1).otherwise(0)).cast("long").alias("low_occupancy_count"),
        F.countDistinct("state").alias("state_count"),
        F.countDistinct("msa").alias("msa_count"),
    )
    mm = max_msa_count(properties)
    out = g.join(mm, g.ticker == mm.reit_ticker, "left").drop("reit_ticker")
    return out.orderBy(F.col("sector").asc_nulls_last(), F.col("total_sqft").desc_nulls_last())


def property_values(properties: DataFrame) -> DataFrame:
    """Annual rent, NOI estimate, value at cap rate and appreciation per property."""
    noi = S.noi_estimate("sqft", "annual_rent_psf", "occupancy_rate")
    return properties.select(
        "property_id", "reit_ticker",
        S.annual_rent("sqft", "annual_rent_psf").alias("annual_rent"),
        noi.alias("noi_estimate"),
        S.value_at_cap(noi, "cap_rate").alias("value_at_cap"),
        S.appreciation("acquisition_cost", "current_book_value").alias("appreciation"),
    )
