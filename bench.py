"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query starts from the landed tables: shared frames are dropped in between, so
every time includes scanning, parsing and all intermediate steps it needs. A query's time
is the median of $BENCH_RUNS runs (3).
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from statistics import median

HEADLINE = (
    "top_wallets", "price_history", "wallet_ledger", "realized_matches", "nearest_history", "price_at_or_after",
    "major_moves", "fixed_markouts", "markout_grid", "entry_features", "adaptive_features", "metadata_features",
    "auc_and_ap", "behavior_vector",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from fillsight.session import local_session
    from registry import all_queries
    from registry.core import reset

    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-"))
    spark.range(1000).selectExpr("sum(id)").collect()
    known = all_queries()
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
            reset()
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
