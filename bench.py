"""Bench: headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]; prints one JSON line.

Each query runs its full plan into the ``noop`` sink (no result collection).
Two warm-up queries run first so JVM start-up, code generation and Python
worker start-up are not charged to the first timed query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cellgrad.plans import catalog  # noqa: E402
from cellgrad.session import build_session  # noqa: E402
from cellgrad.sources.files import run_noop  # noqa: E402

HEADLINE = [
    "train_relational",          # MNIST-like, relational encoding, 3 steps
    "train_and_score",           # train + score every version + best accuracy
    "train_array",               # MNIST-like, array encoding (Arrow batches)
    "train_array_tanh_softmax",  # Iris-array preset on the MNIST-like data
    "predict_models",            # inference for hidden sizes 10/20/50/100 in one query
    "predict_models_correct",    # the same models, array encoding, correct counts
    "predict_scores",            # relational inference, one model from the store
    "predict_correct",           # array inference (Arrow batches), correct flags
    "forward_all_steps",
    "best_accuracy_array",
    "train_relational_lineitem",  # Iris-like net on all lineitem rows
    "train_and_score_lineitem",
    "train_array_lineitem",
    "train_array_lineitem_long",  # ten steps
    "assign_ids",
    "wide_to_coo",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    spark = build_session(f"local[{cpus}]", app="cellgrad-bench", shuffle_partitions=int(cpus))
    # Warm-up: JVM code paths and the Python workers used by Arrow batches.
    run_noop(catalog.q_forward(spark, sf_dir))
    run_noop(catalog.q_predict_correct(spark, sf_dir))
    times = {}
    for name in names:
        t0 = time.perf_counter()
        run_noop(catalog.QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)
        # Leave no cached data or garbage from one query to the next.
        for rdd_id, rdd in list(spark.sparkContext._jsc.getPersistentRDDs().items()):
            rdd.unpersist(True)
        spark.catalog.clearCache()
        spark.sparkContext._jvm.System.gc()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
