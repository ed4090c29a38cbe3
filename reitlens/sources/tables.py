"""Scans of the landed lake tables.

Every reader selects only the columns the derivations need, so the Parquet scan
carries a pruned ``ReadSchema`` and any filter above it is pushed into the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@dataclass
class Lake:
    """Handle on a directory of ``<table>.parquet`` datasets."""

    spark: SparkSession
    root: str
    _cache: dict = field(default_factory=dict, repr=False)
    _derived: dict = field(default_factory=dict, repr=False)

    def derived(self, key: str, build) -> DataFrame:
        """A derived frame built once per lake handle (plans are immutable and reusable)."""
        if key not in self._derived:
            self._derived[key] = build()
        return self._derived[key]

    def table(self, name: str, *columns: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        df = self._cache[name]
        return df.select(*columns) if columns else df


def lake_for(spark: SparkSession, root: str) -> Lake:
    """A new handle, so that files and columns landed since the last query are seen."""
    return Lake(spark, root)
