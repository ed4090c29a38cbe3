"""Every query that has a DuckDB oracle against it on the smallest lake (exact match)."""

import duckdb
import pytest

import __spark_entry__ as E
from reitlens.plans import catalog
from scripts.oracle_check import rows_of
from reitlens.sources.tables import DRIVER_TABLES
from tests.conftest import SF_SMALL

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_of_the_engine_has_an_oracle():
    assert set(catalog.registry()) <= set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(ORACLES[name])
    o_cols = [d[0] for d in res.description]
    assert sorted(s_cols) == sorted(o_cols)
    assert rows_of(s_cols, s_rows, False) == rows_of(o_cols, res.fetchall(), False)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "composite_score" in df.columns
