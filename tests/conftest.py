import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from reitlens.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="reitlens-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect as a list of dicts (optionally only some columns), sorted for stable asserts."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    if cols:
        out = [{c: r[c] for c in cols} for r in out]
    return out
