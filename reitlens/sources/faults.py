"""Derived tables with faults, as a feed would land them: input of the data-quality rules.

Each rule of ``operators.quality`` meets some rows.  A fault replaces one column
of the rows whose number leaves a given remainder; all other rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_faults(df: DataFrame, number: Column, modulus: int, faults: dict[int, tuple[str, object]]) -> DataFrame:
    """``df`` with column := value where ``number`` leaves the remainder, for remainder -> (column, value) in ``faults``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    by_column: dict[str, list[tuple[int, object]]] = {}
    for remainder, (column, value) in faults.items():
        by_column.setdefault(column, []).append((remainder, value))

    def faulty(c: str) -> Column:
        out = F.col(c)
        for remainder, value in by_column.get(c, ()):
            out = F.when(number % modulus == remainder, F.lit(value).cast(types[c])).otherwise(out)
        return out.alias(c)

    return df.select(*[faulty(c) for c in df.columns])


def _digits(column: str) -> Column:
    """The number behind the letter of an id like ``R7`` or ``P12``."""
    return F.substring(column, 2, 20).cast("long")


def reits(df: DataFrame) -> DataFrame:
    return with_faults(df, _digits("ticker"), 10, {1: ("ticker", " "), 2: ("payout_ratio", 2.5), 3: ("sector", "Timberland"), 5: ("payout_ratio", -0.5)})


def properties(df: DataFrame) -> DataFrame:
    return with_faults(df, _digits("property_id"), 11, {
        1: ("occupancy_rate", 1.25), 2: ("sqft", -100.0), 3: ("cap_rate", 0.25), 4: ("property_type", "Land"), 5: ("status", "Unlisted"),
        6: ("reit_ticker", " "), 7: ("property_id", "")})


def metrics(df: DataFrame) -> DataFrame:
    return with_faults(df, _digits("reit_ticker") + F.col("fiscal_year"), 7, {1: ("quarter", 5), 2: ("fiscal_year", 1999), 3: ("reit_ticker", "")})


def filings(df: DataFrame, number: str = "doc_id") -> DataFrame:
    return with_faults(df, F.col(number), 11, {1: ("cik", ""), 2: ("form_type", "S-11"), 3: ("status", "Lost"), 4: ("filing_id", "")})


def indicators(df: DataFrame) -> DataFrame:
    return with_faults(df, F.month("date").cast("long"), 12, {2: ("series_id", ""), 3: ("date", None)})
