"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS (timed runs per query, median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "m1_batch_score", "m8_metric_registry", "m5_ece", "m13_weighted_meter", "m16_area_score_metrics",
    "p1_parse_run_name", "p2_canonical_type", "p11_sweep_rows",
    "g1_aggregate_over_seeds", "g2_aggregate_by_type", "g6_latency_profile", "g9_natural_stats",
    "w1_average_rank", "w6_best_checkpoints",
    "j4_nearest_checkpoint", "j5_inventory_diff", "j12_common_across",
    "d2_select_long_tail", "d7_natural_schedule", "d9_mix_groups", "d11_pair_mix", "d15_shard_assign", "d16_repeat_sampler", "d17_token_batches",
    "s4_upsert_results", "t2_meters", "t7_run_status",
]
# The table whose rows a query works through, for rows per second.
DRIVING = {
    "m": "embeddings", "m13": "events", "p": "lineitem", "g": "lineitem", "g6": "events", "g9": "documents", "w": "lineitem", "w6": "events",
    "j4": "lineitem", "j5": "pages", "j12": "lineitem", "d": "documents", "d11": "embeddings", "d15": "orders", "d16": "orders", "s": "orders", "t": "events",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))

    from tallymill.queries import QUERIES
    from tallymill.session import get_session
    from tallymill.tables import Tables

    spark = get_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    tables = Tables(spark, folder)
    counts = {name: getattr(tables, name).count() for name in sorted(set(DRIVING.values()))}
    times, rates = {}, {}
    for name in HEADLINE:
        measured = []
        for i in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if i:
                measured.append(time.perf_counter() - start)
        times[name] = round(statistics.median(measured), 3)
        short = name.split("_")[0]
        rates[name] = round(counts[DRIVING.get(short) or DRIVING[short[0]]] / times[name])
    line = {
        "metric": "headline query time, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "rows_per_sec": rates, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "runs": runs,
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
