"""Anchor assignment and homographies on hand-made frames."""

import numpy as np

from fathomline.operators import anchors, homography


def test_assignment(spark):
    a = [(1, 0.0, 1, 0.0, 0.0, 50, 0.9, 1.0), (1, 0.5, 2, 5.0, 0.0, 5, 0.9, 1.0), (1, 0.6, 3, 500.0, 0.0, 50, 0.9, None), (1, 0.7, 4, 9.0, 0.0, 50, 0.9, None), (1, 9.0, 5, 0.0, 0.0, 50, None, 1.0)]
    f = [(1, -0.1, 10), (1, 0.0, 11), (1, 1.0, 12), (1, 3.7, 13), (1, 3.71, 14), (1, 9.0, 15)]
    schema = "vehicle_id int, t double, seq int, east double, north double, used int, inlier_ratio double, reproj double"
    out = anchors.assign(spark.createDataFrame(a, schema), spark.createDataFrame(f, "vehicle_id int, t double, seq int")).collect()
    got = {r["seq"]: (r["anchor_seq"], r["rejected"], r["reason"]) for r in out}
    assert got == {
        10: (None, 0, None), 11: (1, 0, None), 12: (4, 2, None), 13: (4, 2, None), 14: (None, 2, "visual_anchor_expired"), 15: (None, 3, "anchor_rejected_low_inlier_ratio"),
    }


def test_homography_with_outliers(spark):
    rng = np.random.default_rng(1)
    h = np.array([[1.1, 0.02, 5.0], [-0.03, 0.95, -2.0], [1e-4, -5e-5, 1.0]])
    src = rng.uniform(0, 400, (60, 2))
    p = np.c_[src, np.ones(60)] @ h.T
    dst = p[:, :2] / p[:, 2:]
    dst[:15] += rng.uniform(50, 90, (15, 2))
    rows = [(1, k, *map(float, src[k]), *map(float, dst[k]), 1.0) for k in range(60)] + [(2, k, 0.0, float(k), 1.0, 1.0, 1.0) for k in range(3)]
    df = spark.createDataFrame(rows, "frame_id int, number int, x double, y double, u double, v double, score double")
    out = {r["frame_id"]: r for r in homography.estimate(df).collect()}
    assert out[1]["inliers"] == 45 and np.allclose(np.array(out[1]["h"]).reshape(3, 3), h, atol=1e-6)
    assert out[2]["n"] == 3 and out[2]["inliers"] == 0 and out[2]["h"] is None
