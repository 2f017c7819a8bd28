"""Ingest rules and rows of fixed width over odd values: null keys, ties, missing numbers, texts that need quotes; rotations against numpy."""

import csv
import io
import json

import numpy as np
from pyspark.sql import functions as F

from fathomline.functions import vision
from fathomline.operators import frames, inertial, ingest, sinks

NAN = float("nan")
TRACK = "vehicle_id bigint, t double, seq bigint, lon double, lat double, alt double"


def track(spark, rows):
    return spark.createDataFrame([(v, t, s, 1.0, 2.0, a) for v, t, s, a in rows], TRACK)


def test_numbers_go_on_over_buckets_and_null_keys(spark):
    times = [5.0, 5.0, 90_000.0, 180_000.0, 180_001.0]
    df = track(spark, [(v, t, s, 0.0) for v in (None, 3) for s, t in enumerate(times)])
    got = {(r["vehicle_id"], r["seq"]): r["index"] for r in ingest.numbered(df).collect()}
    assert got == {(v, s): s + 1 for v in (None, 3) for s in range(5)}
    assert ingest.numbered(df.where("false")).count() == 0


def test_trim_keeps_one_row_before_the_span(spark):
    df = track(spark, [(None, float(t), t, 0.0) for t in range(10)] + [(4, 0.0, 0, 0.0), (4, 100.0, 1, 0.0), (5, 7.0, 0, 0.0)])
    got = sorted(((r["vehicle_id"] or 0), r["seq"]) for r in ingest.trimmed(df, 3.0).collect())
    assert got == [(0, s) for s in range(5, 10)] + [(4, 0), (4, 1), (5, 0)]


def test_frames_left_at_the_end(spark):
    fixes, imu = track(spark, [(1, 0.0, 0, 0.0), (1, 10.0, 1, 0.0)]), track(spark, [(1, 0.0, 0, 0.0), (1, 5.0, 1, 0.0)])
    images = track(spark, [(1, 4.0, 0, 0.0), (1, 6.0, 1, 0.0), (1, 11.0, 2, 0.0), (None, 1.0, 3, 0.0)])
    got = {r["seq"]: r["failure_reason"] for r in ingest.left_waiting(images, fixes, imu).collect()}
    assert got == {1: "waiting_for_future_imu_on_shutdown", 2: "waiting_for_future_gps_on_shutdown", 3: "waiting_for_future_gps_on_shutdown"}


def test_fixes_and_reference_frame(spark):
    df = track(spark, [(1, 0.0, 0, 1.0), (1, 1.0, 1, NAN), (1, 2.0, 2, None), (1, 3.0, 3, 5.0), (1, 3.0, 4, 6.0), (None, 9.0, 5, 7.0)])
    assert sorted(r["seq"] for r in ingest.valid_fixes(df).collect()) == [3, 4, 5]
    assert {r["vehicle_id"]: r["alt"] for r in ingest.reference_frame(df).collect()} == {1: 5.0, None: 7.0}


def test_fused_row_as_line_and_as_json(spark):
    df = spark.createDataFrame([(1, 2.5, NAN, True, 'a "b", c'), (2, None, 1.0, False, None)], "fix_index long, fix_stamp_sec double, gt_lon double, pred_available boolean, failure_reason string")
    lines = {r["fix_index"]: dict(zip(sinks.FUSION_COLUMNS, next(csv.reader(io.StringIO(r["line"]))), strict=True)) for r in sinks.fusion_lines(df).collect()}
    assert lines[1]["fix_stamp_sec"] == "2.500000000" and lines[1]["gt_lon"] == "" and lines[1]["pred_available"] == "1" and lines[1]["failure_reason"] == 'a "b", c'
    assert lines[2]["fix_stamp_sec"] == "" and lines[2]["pred_available"] == "0" and lines[2]["failure_reason"] == ""
    objects = {r["fix_index"]: json.loads(r["json"]) for r in sinks.fusion_json(df).collect()}
    assert list(objects[1]) == sinks.FUSION_COLUMNS and objects[1]["gt_lon"] is None and objects[1]["failure_reason"] == 'a "b", c' and objects[2]["pred_available"] is False


def test_result_row_has_every_column(spark):
    df = spark.createDataFrame([(7, 90.0)], "image_index long, yaw_compass_deg double").select("*", F.lit(4.0).alias("x"), F.lit(None).cast("double").alias("y"), F.lit(9.0).alias("z"))
    (row,) = sinks.result_lines(df, F.col("x"), F.col("y"), F.col("z"), digits=2).collect()
    got = dict(zip(sinks.RESULT_COLUMNS, next(csv.reader(io.StringIO(row["line"]))), strict=True))
    assert len(sinks.RESULT_COLUMNS) == 43 and len(sinks.FUSION_COLUMNS) == 30
    assert (got["pred_x_sigma_m"], got["pred_y_sigma_m"], got["pred_var_diag_m2"], got["heading_east_weight"]) == ("2.00", "nan", "[4.00,nan,9.00]", "1.00")
    assert got["map_feature_points"] == "0" and got["localization_success"] == "0" and got["failure_reason"] == ""


def test_pair_rules(spark):
    pairs = spark.createDataFrame([(1, 0, 0.5, 3), (1, 1, 0.9, 1), (1, 1, 0.2, 0), (1, 0, 0.2, 9), (2, 2, None, 0)], "frame_id int, mode int, score double, i int")
    best = {r["frame_id"]: (r["mode"], r["n"], r["first_score"]) for r in frames.best_mode(pairs, "mode", "score", ["i"]).collect()}
    assert best == {1: (0, 2, 0.5), 2: (2, 1, None)}
    assert frames.scored(pairs, "score", -1.0, {"i": 4}).count() == 4 and frames.scored(pairs, "score", 0.5, {}).count() == 2
    assert frames.first_frames(pairs, 0, "i").count() == 5 and frames.first_frames(pairs, 2, "i").count() == 2
    axis = spark.createDataFrame([(0.0, 0.0, -2.0), (3.0, 0.0, 0.0), (0.0, 0.0, 0.0), (NAN, 0.0, 1.0)], "x double, y double, z double")
    assert [r[0] for r in axis.select(vision.obliqueness(F.col("x"), F.col("y"), F.col("z"))).collect()] == [0.0, 90.0, None, None]


def test_rotations_as_numpy(spark):
    rng = np.random.default_rng(3)
    for v in rng.normal(size=(50, 3)):
        angle = np.linalg.norm(v)
        k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
        want = np.eye(3) + np.sin(angle) / angle * k + (1 - np.cos(angle)) / angle**2 * (k @ k)
        got = inertial.rotation(tuple(v))
        assert np.allclose(got, want, atol=1e-12) and np.allclose(inertial.product(got, got), want @ want, atol=1e-12)
        bent = np.array(got) + rng.normal(size=(3, 3)) * 0.01
        clean = np.array(inertial.orthonormal(tuple(map(tuple, bent))))
        assert np.allclose(clean.T @ clean, np.eye(3), atol=1e-12) and np.allclose(clean[:, 0], bent[:, 0] / np.linalg.norm(bent[:, 0]))
    level = np.array(inertial.level_attitude((0.0, 0.0, -inertial.GRAVITY)))
    assert np.allclose(level, [[0, 1, 0], [1, 0, 0], [0, 0, -1]])
