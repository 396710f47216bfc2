"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``: one cold run, then ``$BENCH_REPEAT`` warm runs (best
kept). Each run executes the full plan into Spark's ``noop`` sink, so
nothing is collected to the driver. A small generic job (not one of the
queries) runs first so JVM start-up is not charged to the first query.
Prints one JSON line.
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stockgrid.plans import catalog  # noqa: E402
from stockgrid.session import build_session  # noqa: E402

HEADLINE = [
    "ordering_grid", "grid_join_form", "reconciliation_variance", "kpis", "duplicate_rows",
    "build_master", "apply_overrides", "top_at_risk", "reconciliation_summary",
]


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    df = catalog.REGISTRY[name].build(spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else (list(catalog.REGISTRY) if os.environ.get("BENCH_ALL") else HEADLINE)
    spark = build_session(
        f"local[{cpus}]", app_name="stockgrid-bench", shuffle_partitions=max(8, 2 * cpus),
        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g")})
    spark.range(0, 100000).selectExpr("id % 7 as k").groupBy("k").count().write.format("noop").mode(
        "overwrite").save()
    cold, warm = {}, {}
    for n in names:
        cold[n] = round(run(spark, n, sf_dir), 3)
        warm[n] = round(min(run(spark, n, sf_dir) for _ in range(max(1, repeat))), 3)
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    out = {
        "metric": "headline_queries_warm_total",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "cold_total": round(sum(cold.values()), 3),
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
