"""The scheduled run end to end on the smallest lake; a re-run does not duplicate output."""

from reitlens.plans import pipeline
from tests.conftest import SF_SMALL


def test_pipeline_runs_and_is_idempotent(spark):
    paths = pipeline.run(spark, SF_SMALL)
    n_reits = spark.read.parquet(paths["reits"]).count()
    signals = spark.read.parquet(paths["reit_signals"])
    assert signals.count() == n_reits > 0
    assert spark.sql("SELECT count(*) AS n FROM reit_fundamentals_v").first()["n"] > 0
    assert spark.sql("SELECT count(*) AS n FROM market_correlation_v").first()["n"] > 0
    root = paths["reits"].rsplit("/", 1)[0]
    again = pipeline.run(spark, SF_SMALL, out_root=root)
    assert spark.read.parquet(again["reit_signals"]).count() == n_reits
    assert spark.read.parquet(again["sector_benchmarks"]).count() == \
        spark.read.parquet(paths["sector_benchmarks"]).count()
