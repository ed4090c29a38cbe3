"""Scale rules checked on every registered query's physical plan."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")
# the stream query writes and reads its sink while being built; its plan is a file scan
SKIP = {"stream_landed_filings"}


@pytest.mark.parametrize("name", sorted(set(E.queries()) - SKIP))
def test_plan_has_no_cross_joins_or_python(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    bad = [op for op in FORBIDDEN if op in plan]
    assert bad == [], f"{name}: {bad}"
