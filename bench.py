"""Headline-query timings.

Runs the headline queries on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and prints one JSON line.  Each query is executed
in full through the ``noop`` sink (nothing is collected to the driver); the
feature row runs once before, uncounted, and warms the session.  ``build`` is the
share of each time that passes before the plan is executed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "h9_train_features", "h10_scored_features", "b11_train_processed", "e2_watch_gap",
    "d5_order_features", "b0_telecom_table", "b14_cross_features", "j2_stratified_folds",
    "l1_variance", "l2_chi2", "l6_f_scores", "l4_mic", "k5_knn_classify", "l12_smote",
    "l16_relative_distance", "h5_pipeline_holdout",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from churnlens.session import get_session
    from churnlens.plans.registry import QUERIES

    spark = get_session("churnlens-bench", master=f"local[{cpus}]", conf={
        "spark.sql.shuffle.partitions": str(max(8, 2 * int(cpus))),
        "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    # Warm-up: JVM, Python workers, parquet footers.
    QUERIES["h9_train_features"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, build = {}, {}
    for n in names:
        t0 = time.time()
        df = QUERIES[n](spark, sf_dir)
        build[n] = round(time.time() - t0, 3)
        df.write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "build": build, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
