"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEATS (default 3,
after one warm-up; the median counts; one repeat after a warm-up of over 20 s). Every result is computed whole into a null sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

import pyspark

from voxtrail.plans import QUERIES
from voxtrail.plans.decoding import draws as group_draws
from voxtrail.plans.registry import Context
from voxtrail.session import local_session

HEADLINE = [
    "a14_group_cells", "a15_voxel_group_map", "p11_key_set_check", "v3_source_zscore", "v7_dissimilarity_matrix",
    "v8_dissimilarity_correlation", "v10_map_similarity", "v16_smoothing", "v17_components", "d4_cross_single_split",
    "d6_averaged_within", "d11_diagonal_lda", "d13_linear_svm", "d15_searchlight", "d20_whitening_leakage",
    "n4_observed_and_null", "n4_full_null", "d14_svm_top50", "n6_group_resampling", "n7_empirical_p",
    "j9_radius_join", "j11_nearest_sample", "w5_time_course", "v20_linear_model",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cpus, "bench")
    times = {}
    for name in HEADLINE:
        first = run(spark, name, sf_dir)
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(1 if first > 20 else repeats)), 3)
    folds = QUERIES["d11_diagonal_lda"](spark, sf_dir).count()
    hinge = QUERIES["d13_linear_svm"](spark, sf_dir).count()
    within = QUERIES["d6_averaged_within"](spark, sf_dir).count()
    nulls = QUERIES["n4_observed_and_null"](spark, sf_dir).count()
    start = time.perf_counter()
    draws = group_draws(Context(spark, sf_dir), 100_000).count()
    drawn = time.perf_counter() - start
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "spark": pyspark.__version__,
        "rates": {"models_per_sec": round(folds / times["d11_diagonal_lda"], 1),
                  "margin_models_per_sec": round(hinge / times["d13_linear_svm"], 1),
                  "averaged_models_per_sec": round(within / times["d6_averaged_within"], 1),
                  "null_values_per_sec": round(nulls / times["n4_observed_and_null"], 1),
                  "full_null_repeat_values_per_sec": round(nulls * 30 / times["n4_full_null"], 1),
                  "group_draws_per_sec": round(draws / drawn, 1)}}))


if __name__ == "__main__":
    main()
