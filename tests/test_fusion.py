"""The filter: sources, late events, and streaming against batch."""

import math

import pandas as pd
import pytest

from fathomline.operators import inertial
from fathomline.streaming import fusion

K = fusion.Tuning()


def imu(t, seq=0, a=(0.0, 0.0, 0.0)):
    return (t, seq, 0, *a, None, None, None)


def visual(t, seq=0, at=(0.0, 0.0, 0.0)):
    return (t, seq, 1, *at, 9.0, 9.0, 4.0)


def run(events):
    tracker = fusion.Tracker()
    out = []
    for e in events:
        out += tracker.take(e, K)
        tracker = fusion.Tracker.load(tracker.dump())
    return out, tracker


def test_sources_in_order():
    out, _ = run([imu(0.0), visual(0.05), imu(0.1), visual(0.15), visual(0.2, at=(500.0, 0.0, 0.0)), imu(1.0), visual(3.0)])
    assert [r[2] for r in out] == ["visual_init", "imu_predict", "visual_update", "visual_reject_nis", "imu_gap_restart", "visual_reinit_after_gap"]


@pytest.mark.parametrize(("lag", "used"), [(0.5, True), (2.9, True), (3.1, False)])
def test_late_visual(lag, used):
    base = [visual(0.0)] + [imu(0.1 * k, k, (1.0, 0.0, 0.0)) for k in range(1, 40)]
    late = visual(3.9 - lag, 99, (5.0, 0.0, 0.0))
    out, tracker = run([*base, late])
    assert (out[-1][2].endswith("_replayed")) == used
    if used:
        ordered, same = run(sorted([*base, late]))
        assert tracker.now.pos == pytest.approx(same.now.pos) and tracker.now.var == pytest.approx(same.now.var)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(v, *e) for v in (1, 2) for e in [visual(0.0), *[imu(0.1 * k, k, (0.5 * v, 0.0, 0.1)) for k in range(1, 12)], visual(0.55, 50, (0.1, 0.0, 0.0))]]
    schema = "vehicle_id int, t double, seq bigint, kind int, x double, y double, z double, vx double, vy double, vz double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = fusion.fuse_stream(stream).writeStream.format("memory").queryName("fused").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("fused").toPandas().sort_values(["vehicle_id", "t", "source"]).reset_index(drop=True)
    want = fusion.fuse(spark.createDataFrame(rows, schema)).toPandas().sort_values(["vehicle_id", "t", "source"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_attitude_at_rest(spark):
    rows = [(1, 0.1 * k, k, 0.0, 0.0, 0.0, 0.0, 0.0, -inertial.GRAVITY) for k in range(1, 41)]
    df = spark.createDataFrame(rows, "vehicle_id int, t double, seq int, gx double, gy double, gz double, ax double, ay double, az double")
    out = inertial.attitudes(df).collect()
    assert len(out) == 21
    assert all(abs(r["roll"]) < 1e-9 and abs(r["pitch"]) < 1e-9 and math.hypot(r["a_east"], r["a_north"], r["a_up"]) < 1e-9 for r in out)


def test_full_covariance_is_numpys():
    import numpy as np

    k = fusion.Tuning(max_gap=10.0, reinit_gap=100.0, nis_gate=0.0, damping=0.0, damping_z=0.0)
    r0, r1 = np.array([[9.0, 2.0, 0.5], [2.0, 6.0, -1.0], [0.5, -1.0, 4.0]]), np.array([[4.0, -1.5, 0.0], [-1.5, 5.0, 0.3], [0.0, 0.3, 2.0]])
    row = lambda t, z, r: (t, 0, 1, *z, r[0, 0], r[1, 1], r[2, 2], r[0, 1], r[0, 2], r[1, 2], None)
    f = fusion.Filter()
    f.apply(row(0.0, (1.0, 2.0, 3.0), r0), k)
    out = f.apply(row(0.5, (2.0, 0.0, 3.5), r1), k)
    grown = 0.25 * k.accel_sigma**2 * 0.5**4
    p = r0 + np.diag([k.walk_xy**2 * 0.5 + grown, k.walk_xy**2 * 0.5 + grown, k.walk_z**2 * 0.5 + grown])
    v = np.array([1.0, -2.0, 0.5])
    s = np.linalg.inv(p + r1)
    gain = p @ s
    rest = np.eye(3) - gain
    assert out[2] == "visual_update" and out[-1] == pytest.approx(v @ s @ v)
    assert f.pos == pytest.approx(list(np.array([1.0, 2.0, 3.0]) + gain @ v))
    assert np.allclose(f.cov, rest @ p @ rest.T + gain @ r1 @ gain.T) and out[6:9] == pytest.approx(tuple(np.diag(f.cov)))


def test_values_that_are_not_finite():
    out, tracker = run([visual(0.0), imu(0.1, 1, (1.0, 0.0, 0.0)), imu(0.15, 2, (math.nan, 0.0, 0.0)), visual(0.2, 3, (math.nan, 0.0, 0.0)), imu(0.3, 4), visual(0.35, 5), (0.4, 6, 1, 0.0, 0.0, 0.0, math.nan, 9.0, 4.0)])
    assert [r[2] for r in out] == ["visual_init", "imu_predict", "visual_reject_invalid_pose", "imu_predict", "visual_update"]
    assert all(math.isfinite(x) for r in out for x in r[3:10])
    assert run([visual(0.0, at=(None, 0.0, 0.0))])[0] == []
    assert tracker.now.t == 0.35


def test_rejected_measurements_move_the_filter():
    bad = (0.2, 3, 1, 50.0, 50.0, 50.0, 9.0, 9.0, 4.0, None, None, None, "anchor_rejected_low_used_points")
    out, tracker = run([bad, visual(0.0), imu(0.1, 1, (1.0, 0.0, 0.0)), bad])
    assert [r[2] for r in out] == ["visual_init", "imu_predict", "anchor_rejected_low_used_points"]
    assert tracker.now.t == 0.2 and 0 < tracker.now.pos[0] < 1


def test_events_carry_covariances_and_reasons(spark):
    imu_rows = spark.createDataFrame([("a", 0.1, 1, 0.0, 0.0, 0.0)], "vehicle_id string, t double, seq int, a_east double, a_north double, a_up double")
    names = "vehicle_id string, t double, seq int, east double, north double, up double, var_e double, var_n double, var_u double"
    plain = spark.createDataFrame([("a", 0.0, 1, 0.0, 0.0, 0.0, 9.0, 9.0, 4.0)], names)
    full = spark.createDataFrame([("a", 0.0, 1, 0.0, 0.0, 0.0, 9.0, 9.0, 4.0, 3.0, "low"), ("a", 0.05, 2, 0.0, 0.0, 0.0, 9.0, 9.0, 4.0, 3.0, None)], names + ", cov_en double, reason string")
    got = fusion.events(imu_rows, plain).unionByName(fusion.events(imu_rows.where("false"), full)).where("kind = 1").select("cen", "ceu", "bad").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, None, None), (3.0, None, "low"), (3.0, None, None)], key=repr)
    assert [r["source"] for r in fusion.fuse(fusion.events(imu_rows, full)).orderBy("t").collect()] == ["visual_init", "imu_predict"]
