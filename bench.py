"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from fathomline.plans.registry import QUERIES
from fathomline.session import local_session

HEADLINE = [
    "traj_error_summary", "j3_asof_interp", "j8_asof_backward", "w1_sliding_ols", "w3_heading", "w5_jump_filter", "w6_gap_fill", "a9_throttle",
    "g4_terrain", "g6_robust_covariance", "a26_axis_variances", "o3_top_k", "j14_knn_ratio", "j17_bilinear", "t5_fusion_filter", "w8_attitude",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start-up isn't measured
    times = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
