"""Headline queries, timed once each after a warm-up: prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores. Results go to the no-op sink, so every row
and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
import warnings

warnings.filterwarnings("ignore")

from queries import QUERIES  # noqa: E402
from telemill.session import local_session  # noqa: E402

HEADLINE = [
    "features_full_shipments", "features_ema", "wide_features", "features_generic_sensors", "clean_basic", "incident_rows",
    "incident_labels", "keep_last_arrival", "fill_along_well", "leak_event_runs", "exact_quantiles", "roc_auc_exact",
    "binary_metric_bundle", "model_metric_table", "calibrated_thresholds", "alerts_persistence", "alerts_gated", "quality_checks",
    "training_corpus", "group_folds", "training_frame", "model_matrix", "isolation_forest_scores", "stream_alerts", "stream_features",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    warm = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    for name in ("features_full_shipments", "alerts_persistence"):
        QUERIES[name](spark, warm if os.path.isdir(warm) else folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
