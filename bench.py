"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and
print one JSON line with per-query seconds.

Every query is executed completely through the ``noop`` sink (no collect to the
driver), so the timing covers the whole distributed plan.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardline.plans.catalog import QUERIES  # noqa: E402
from wardline.plans.session import build_session  # noqa: E402

HEADLINE = [
    "category_outcomes",          # flagship: joins, code harmonisation, CCSR fan-out, aggregates
    "feature_table",              # per-diagnosis features
    "admission_rollup",           # admission-level roll-up
    "seq_padded",                 # patient trajectories, vocabulary, padding
    "admission_text_tokens",      # generated text records
    "auroc_ap_by_race",           # ranking metrics
    "threshold_best_f1_by_race",  # grid threshold search
    "calibration_summary_by_race",
    "subgroup_report",            # bootstrap CIs per subgroup
    "disparity_gaps",             # bootstrap of max-min gaps
    "mortality_leaderboard",      # MLlib fits + scoring
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, app="wardline-bench")
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
