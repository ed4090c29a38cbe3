"""Data-quality rules per entity: rows are split into valid and quarantined.

The application raises on the first bad record; a distributed job instead
tags every row with the list of rules it breaks (``dq_errors``), keeps the
clean rows and routes the rest to a quarantine sink.  Tickers are normalised
(strip + upper) before the rules run, as on construction of a record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reitlens import constants as K
from reitlens.functions import scalars as S

Rule = tuple[Column, Column]


def _msg(text: str) -> Column:
    return F.lit(text)


def tag(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``dq_errors`` (array of messages of the broken rules, in rule order)."""
    errs = F.array(*[F.when(bad, msg) for bad, msg in rules])
    return df.withColumn("dq_errors", F.filter(errs, lambda x: x.isNotNull()))


def valid(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.size("dq_errors") == 0).drop("dq_errors")


def quarantine(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.size("dq_errors") > 0)


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _num(c: str) -> Column:
    return F.col(c).cast("string")


# FIXED VALUES — bounds and messages of the rules below
def reit_rules() -> list[Rule]:
    p, cap = F.col("payout_ratio"), F.col("market_cap")
    return [
        (_empty("ticker"), _msg("REIT ticker must be non-empty")),
        ((p < 0) | (p > 2.0), F.concat(F.lit("Payout ratio "), _num("payout_ratio"),
                                       F.lit(" out of valid range [0, 2.0]"))),
        (cap < 0, _msg("Market cap must be non-negative")),
        (F.col("sector").isNotNull() & ~F.col("sector").isin(*K.SECTORS),
         F.concat(F.lit("Unknown sector "), F.col("sector"))),
    ]


def property_rules() -> list[Rule]:
    occ, cap = F.col("occupancy_rate"), F.col("cap_rate")
    return [
        (_empty("property_id"), _msg("Property ID must be non-empty")),
        (_empty("reit_ticker"), _msg("REIT ticker must be non-empty")),
        ((occ < 0.0) | (occ > 1.0), F.concat(F.lit("Occupancy rate "), _num("occupancy_rate"),
                                             F.lit(" must be in [0, 1]"))),
        (F.col("sqft") < 0, _msg("Square footage must be non-negative")),
        ((cap < 0) | (cap > 0.20), F.concat(F.lit("Cap rate "), _num("cap_rate"),
                                            F.lit(" out of expected range [0, 0.20]"))),
        (F.col("property_type").isNotNull() & ~F.col("property_type").isin(*K.PROPERTY_TYPES),
         F.concat(F.lit("Unknown property type "), F.col("property_type"))),
        (F.col("status").isNotNull() & ~F.col("status").isin(*K.PROPERTY_STATUSES),
         F.concat(F.lit("Unknown status "), F.col("status"))),
    ]


def metric_rules() -> list[Rule]:
    q = F.col("quarter")
    return [
        (_empty("reit_ticker"), _msg("REIT ticker must be non-empty")),
        ((q < 1) | (q > 4), F.concat(F.lit("Quarter must be 1-4, got "), _num("quarter"))),
        (F.col("fiscal_year") < 2000, F.concat(F.lit("Invalid fiscal year: "), _num("fiscal_year"))),
    ]


def filing_rules() -> list[Rule]:
    return [
        (_empty("filing_id"), _msg("Filing ID must be non-empty")),
        (_empty("cik"), _msg("CIK must be non-empty")),
        (F.col("form_type").isNotNull() & ~F.col("form_type").isin(*K.FORM_TYPES),
         F.concat(F.lit("Unknown form type "), F.col("form_type"))),
        (F.col("status").isNotNull() & ~F.col("status").isin(*K.FILING_STATUSES),
         F.concat(F.lit("Unknown status "), F.col("status"))),
    ]


def indicator_rules() -> list[Rule]:
    return [
        (_empty("series_id"), _msg("Series ID must be non-empty")),
        (F.col("date").isNull() | (F.col("date").cast("string") == ""), _msg("Date must be non-empty")),
    ]


def normalise(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, S.norm_ticker(column))


def dq_reits(reits: DataFrame) -> DataFrame:
    return tag(normalise(reits, "ticker"), reit_rules())


def dq_properties(properties: DataFrame) -> DataFrame:
    return tag(normalise(properties, "reit_ticker"), property_rules())


def dq_metrics(metrics: DataFrame) -> DataFrame:
    return tag(normalise(metrics, "reit_ticker"), metric_rules())


def dq_filings(filings: DataFrame) -> DataFrame:
    return tag(normalise(filings, "reit_ticker"), filing_rules())


def dq_indicators(indicators: DataFrame) -> DataFrame:
    return tag(indicators, indicator_rules())
