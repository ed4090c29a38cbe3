"""The scheduled analysis run as one Spark application.

The application's orchestrated flow (ingest → compute scores → analysis →
write signals) becomes:

1. derive the REIT-shaped tables from the lake and **materialise** them as
   Parquet under ``out_root`` (this cuts lineage: every later step reads the
   written tables, so a lost executor never recomputes the line-item
   aggregation from scratch);
2. store the three analysis views and define them in the catalog;
3. compute sector benchmarks and the full report for every REIT;
4. append benchmark and signal rows idempotently (dynamic partition overwrite
   per run date), and quarantine rows that break data-quality rules.

``out_root`` must be shared storage on a cluster; by default it is a folder
under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reitlens import constants as K
from reitlens.operators import asof as AS
from reitlens.operators import fundamentals as FU
from reitlens.operators import macro as MA
from reitlens.operators import peers as PE
from reitlens.operators import prices as PR
from reitlens.operators import properties as PP
from reitlens.operators import quality as DQ
from reitlens.operators import scores as SC
from reitlens.session import ensure_checkpoint_dir
from reitlens.sinks import writers as W
from reitlens.sources import bind, dims
from reitlens.sources.tables import lake_for


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and return a frame reading it back (lineage cut)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def run(spark: SparkSession, sf_dir: str, out_root: str | None = None,
        run_ts: str = "2024-06-28 12:00:00") -> dict[str, str]:
    """Run the whole analysis; returns the output paths by name."""
    root = (out_root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}").rstrip("/")
    lake = lake_for(spark, sf_dir)
    ts = F.lit(run_ts).cast("timestamp_ntz")
    paths = {n: f"{root}/{n}" for n in ("reits", "financial_metrics", "properties", "price_data",
                                        "market_indicators", "sector_benchmarks", "reit_signals",
                                        "quarantine")}

    # 1. derived tables, materialised
    reits_raw = bind.reits(lake, signed_market_cap=True)
    tagged = DQ.dq_reits(reits_raw)
    W.sink_quarantine(tagged, paths["quarantine"], "reits")
    reits = materialise(DQ.valid(tagged).withColumn("market_cap", F.abs("market_cap")), paths["reits"])
    metrics = materialise(bind.financial_metrics(lake), paths["financial_metrics"])
    props = materialise(bind.properties(lake), paths["properties"])
    prices = materialise(bind.price_data(lake), paths["price_data"])
    ind = materialise(MA.market_indicators(bind.market_indicator_values(lake), dims.series(spark)),
                      paths["market_indicators"])

    # 2. views over the written tables
    rates = AS.asof_rates(prices, ind)
    W.sink_views(spark, {
        "reit_fundamentals_v": FU.reit_fundamentals(reits, metrics),
        "property_analysis_v": PP.property_analysis(reits, props),
        "market_correlation_v": PR.market_correlation(prices, reits, rates),
    }, f"{root}/views")

    # 3-4. benchmarks and signals, appended per run date
    W.sink_benchmarks(PE.agg_sector_benchmarks(reits, metrics), paths["sector_benchmarks"], ts)
    summary = PR.price_metrics(prices)
    report = SC.full_report(reits, metrics, summary, MA.rate_environment(ind))
    W.sink_signals(SC.signals_for_sink(report, ts), paths["reit_signals"])
    return paths
