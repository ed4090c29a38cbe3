"""Benchmark: run the registered queries on ``$BENCH_SF_DIR`` and print one JSON line.

Each query is executed in full with the ``noop`` sink (every row is computed,
nothing is collected to the driver).  A short warm-up runs first so that JVM
start-up is not charged to the first query.  ``value`` is the sum over the
headline queries; ``queries`` lists every registered query's time.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list to restrict), BENCH_ALL=0 to time headline queries only.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from reitlens.plans import catalog  # noqa: E402
from reitlens.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    run_all = os.environ.get("BENCH_ALL", "1") != "0"
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    reg = catalog.registry()
    names = only or [n for n, e in reg.items() if run_all or e.headline]
    headline = {n for n, e in reg.items() if e.headline}

    # warm-up (not timed)
    reg["latest_metric"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()

    head_total = sum(t for n, t in times.items() if n in headline) if not only else sum(times.values())
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total_sec",
        "value": round(head_total, 3),
        "unit": "sec",
        "queries": times,
        "all_queries_total_sec": round(sum(times.values()), 3),
        "headline": sorted(headline & set(times)),
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
