"""Times the headline queries and prints one JSON line.

Each query runs twice: ``cold`` holds the first runs (planning and code generation included),
``queries`` and ``value`` the second ones.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from timbrel.plans.catalogue import QUERIES
from timbrel.session import local_session

HEADLINE = """patient_decisions w1_jitter w5_apq_dda w6_longest_active_run w13_baseline_drift
w14_newest_ten g2_frame_energy g3_spectrogram_flatness g8_harmonicity a14_period_entropy
a15_recurrence_entropy a17_speech_levels a20_spread_measures a21_correlation_dimension
a22_detrended_fluctuation j1_screening_baseline_join j2_cohort_similarity j3_nearest_references
m3_density_outlier j5_full_score_join a2_pool_summary a9_roc_auc m7_subject_level_split
m19_batch_scoring r7_decision_fusion s8_last_wins_upsert t1_token_bucket t4_activity_sessions
t2_sliding_windows""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    # start the JVM paths and one Python worker before anything is timed
    QUERIES["r9_certainty_label"](spark, folder).write.format("noop").mode("overwrite").save()
    cold, times = {}, {}
    for name in HEADLINE:
        for kept in (cold, times):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            kept[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "cold": cold,
        "cold_total": round(sum(cold.values()), 3),
        "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
