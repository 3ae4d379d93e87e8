"""Wall time of the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from knowntime.catalog.all import QUERIES  # noqa: E402
from knowntime.session import build_session  # noqa: E402

HEADLINE = ("rolling_form_20", "scheduled_order_form", "rating_fold", "delay_scenarios", "box_ratio_form",
            "latest_quote_per_book", "market_features", "payload_archive_flatten", "fuzzy_event_match",
            "market_constraint_suite", "impact_features", "expected_starter_features", "report_text_rows",
            "three_way_scores", "bootstrap_relative_weeks", "allocation_replay_summary", "ledger_monitor",
            "schedule_merge_times", "logistic_fold_scores", "stream_ratings")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()      # start the engine outside the timings
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
