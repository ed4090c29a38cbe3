"""Queries that take every supplier: no condition leaves some out, in the SQL or in the rows."""

import duckdb
import pytest

import __spark_entry__ as E
from reitlens.plans import oracle as O
from reitlens.sources import bind
from reitlens.sources.tables import lake_for
from scripts.oracle_check import rows_of

SF = "/root/testdata/sf0.001"
WHOLE = (
    "reit_fundamentals",
    "latest_metric",
    "join_latest_metric",
    "filter_fiscal_year",
    "get_by_sector",
    "agg_peer_avg",
    "peer_comparison_etl",
    "agg_sector_benchmarks_etl",
    "agg_sector_benchmarks",
    "peer_comparison",
    "sector_peers",
    "dividend_safety",
    "valuation",
    "property_analysis",
    "score_fundamental",
    "score_valuation",
    "score_sentiment",
    "load_reits",
    "load_metrics",
    "reit_scalars",
    "metric_scalars",
)


def test_derived_tables_hold_every_supplier(spark):
    lake = lake_for(spark, SF)
    suppliers = {f"R{r[0]}" for r in lake.table("supplier", "s_suppkey").collect()}
    shipped = {f"R{r[0]}" for r in lake.table("lineitem", "l_suppkey").distinct().collect()}
    assert {r[0] for r in bind.reits(lake).select("ticker").collect()} == suppliers
    assert {r[0] for r in bind.financial_metrics(lake).select("reit_ticker").distinct().collect()} == shipped


@pytest.mark.parametrize("name", WHOLE)
def test_query_takes_every_supplier(spark, name):
    sql = E.oracle_sql()[name]
    assert O.LISTED_ONLY not in sql and O.REPORTING_ONLY not in sql
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "customer", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(sql)
    df = E.queries()[name](spark, SF)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()], False) == rows_of([d[0] for d in want.description], want.fetchall(), False)
