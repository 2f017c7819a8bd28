"""The gate's closing in filter and anchors; rows published once; matching by hashes; two geometries."""

import json
import math

import pytest
from pyspark.sql import functions as F

from fathomline.operators import anchors, dual_geometry, matching, sinks
from fathomline.streaming import fusion


def test_closing_forgets_all_but_the_scale():
    k = fusion.Tuning(adaptive=True)
    tracker, out = fusion.Tracker(), []
    for e in [(0.0, 0, 1, 0.0, 0.0, 0.0, 9.0, 9.0, 4.0), (0.1, 1, 0, 1.0, 0.0, 0.0, None, None, None), (0.2, 2, 1, 9.0, 0.0, 0.0, 9.0, 9.0, 4.0)]:
        out += tracker.take(e, k)
    scale = tracker.now.scale
    assert scale != 1.0 and tracker.take((0.3, 3, 2, *[None] * 10), k) == []
    assert tracker.now == fusion.Filter(scale=scale) and not tracker.past
    assert tracker.take((0.4, 4, 0, 1.0, 0.0, 0.0, None, None, None), k) == []
    (row,) = tracker.take((0.5, 5, 1, 1.0, 2.0, 3.0, 9.0, 9.0, 4.0), k)
    assert row[2] == "visual_init" and row[3:6] == (1.0, 2.0, 3.0) and row[6] == pytest.approx(9.0 * scale)
    assert fusion.Tracker.load(tracker.dump()).now == tracker.now


def test_closes_are_events(spark):
    imu = spark.createDataFrame([("a", 0.1 * k, k, 0.0, 0.0, 0.0) for k in range(8)], "vehicle_id string, t double, seq int, a_east double, a_north double, a_up double")
    visual = spark.createDataFrame([("a", t, 90 + k, 0.0, 0.0, 0.0, 9.0, 9.0, 4.0) for k, t in enumerate((0.05, 0.25, 0.55))], "vehicle_id string, t double, seq int, east double, north double, up double, var_e double, var_n double, var_u double")
    closes = spark.createDataFrame([("a", 0.4, 50)], "vehicle_id string, t double, seq int")
    got = [r["source"] for r in fusion.fuse(fusion.events(imu, visual, closes)).orderBy("t", "seq").collect()]
    assert got == ["visual_init", "imu_predict", "imu_predict", "visual_update", "imu_predict", "imu_predict", "visual_init", "imu_predict", "imu_predict"]


def test_anchors_are_forgotten_at_the_closing_edge(spark):
    given = spark.createDataFrame([("a", t, k, 0.0, 0.0, 50, 0.9, 1.0) for k, t in enumerate((1.0, 2.5, 3.2))], "vehicle_id string, t double, seq int, east double, north double, used int, inlier_ratio double, reproj double")
    fixes = spark.createDataFrame([("a", t, k, o) for k, (t, o) in enumerate([(1.5, True), (2.0, False), (3.0, None), (3.1, True), (3.5, True), (3.6, False), (3.7, True)])], "vehicle_id string, t double, seq int, is_open boolean")
    got = {r["seq"]: (r["anchor_seq"], r["reason"]) for r in anchors.assign(given, fixes).collect()}
    # What came while the gate was closed is taken when it opens; what was active or waiting at its closing isn't.
    assert got == {0: (0, None), 3: (1, None), 4: (2, None), 6: (None, None)}


def test_rows_are_published_once(spark, tmp_path):
    schema = "vehicle_id string, t double, x double"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert sinks.last_rows(spark, out) is None
    batches = [[("a", 1.0, 1.0), ("b", 5.0, None)], [("a", 3.0, 3.0), ("a", 2.0, 2.0), (None, 1.0, 0.5)], [("b", 4.0, 9.0), ("c", None, 1.0)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        sinks.publish(spark.readStream.schema(schema).parquet(source), out).awaitTermination()
    def values(df):
        return sorted((json.loads(r["value"]) for r in df.collect()), key=repr)
    published = values(spark.read.parquet(f"{out}/rows"))
    assert published == sorted(({"vehicle_id": v, "t": t, "x": x} for rows in batches for v, t, x in rows), key=repr)
    want = sorted(({"vehicle_id": v, "t": t, "x": x} for v, t, x in [("a", 3.0, 3.0), ("b", 5.0, None), (None, 1.0, 0.5), ("c", None, 1.0)]), key=repr)
    assert values(sinks.last_rows(spark, out)) == want
    # The last batch once more, as after a failure between its output and its commit.
    number = max(int(p.name) for p in (tmp_path / "out/checkpoint/commits").iterdir() if p.name.isdigit())
    (tmp_path / f"out/checkpoint/commits/{number}").unlink()
    (tmp_path / f"out/checkpoint/commits/.{number}.crc").unlink(missing_ok=True)
    sinks.publish(spark.readStream.schema(schema).parquet(source), out).awaitTermination()
    assert values(spark.read.parquet(f"{out}/rows")) == published and values(sinks.last_rows(spark, out)) == want


def test_blocks_find_what_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 16)
    rows = spark.range(90).select("id", F.array(*[F.sin(F.col("id") * (k + 1.3)) for k in range(5)]).alias("vec"))
    one, other = rows.where("id % 2 = 1").withColumnRenamed("id", "q"), rows.where("id % 2 = 0").withColumnRenamed("id", "p")
    all_q, all_p = ([(r[0], r[1]) for r in df.collect()] for df in (one, other))
    want = {(q, p, k + 1) for q, v in all_q for k, (_, p) in enumerate(sorted((math.dist(v, x), p) for p, x in all_p)[:3])}
    assert {(r["q"], r["p"], r["rank"]) for r in matching.nearest(one, other, 3).collect()} == want
    near = {(r["q"], r["p"], r["rank"]) for r in matching.nearest_by_hashes(one, other, 3, tables=10, width=1.0).collect()}
    assert len(near) == len(want) and len(near & want) >= 0.9 * len(want)
    assert matching.nearest(one, other.where("false"), 3).count() == matching.nearest(one.where("false"), other, 3).count() == 0
    assert matching.nearest(one, other.limit(1), 3).count() == len(all_q)


def test_two_geometries(spark):
    schema = "frame_id bigint, u double, v double, hu double, hv double, x double, y double, z double, score double"
    plain = [(1, 10.0 * k, 5.0 * k, 10.0 * k + 0.5, 5.0 * k, 2.0 * k, 1.0 * k, 0.0, 0.5) for k in range(6)]
    odd = [(2, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0)] * 3 + [(3, 1.0, 1.0, math.nan, 1.0, 0.0, 0.0, 0.0, 1.0)] * 5 + [(4, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0)] * 5
    down = [1.0, 0, 0, 0, -1.0, 0, 0, 0, -1.0]
    pose = spark.createDataFrame([(f, [float(x) for x in down], [0.0, 0.0, 50.0], 250.0, 250.0, 0.0, 0.0) for f in (1, 2, 3)], "frame_id bigint, r array<double>, t array<double>, fx double, fy double, cx double, cy double")
    got = {r["frame_id"]: r for r in dual_geometry.statistics(spark.createDataFrame(plain + odd, schema), pose).collect()}
    assert {f: (r["shared"], r["valid"]) for f, r in got.items()} == {1: (6, True), 2: (3, False), 3: (0, False), 4: (0, False)}
    r = got[1]
    assert r["j"] == pytest.approx([5.0, 0.0, 0.0, -5.0]) and r["condition"] == pytest.approx(1.0) and r["scale"] == pytest.approx(0.2)
    # v is predicted with the other sign: the residual grows with k
    assert r["rmse_h"] == pytest.approx(0.5) and r["px_var_u"] == pytest.approx(1e-4) and r["var_x"] == pytest.approx(1e-4 / 25) and r["px_var_v"] > 1
    tilted = spark.sql("SELECT array(1D, 0D, 0D, 0D, 0D, -1D, 0D, 1D, 0D) AS r, array(1D, 0D, 0D, 0D, -1D, 0D, 0D, 0D, -1D) AS s, array(1D, 1D, 1D, 1.0000000001D) AS j")
    row = tilted.select(dual_geometry.pose_obliqueness(F.col("r")).alias("a"), dual_geometry.pose_obliqueness(F.col("s")).alias("b"), dual_geometry.pixel_to_ground(F.col("j")).alias("g")).first()
    assert row["a"] == pytest.approx(90.0) and row["b"] == pytest.approx(0.0) and row["g"] == pytest.approx([0.25] * 4, abs=1e-3)
    h = spark.createDataFrame([(1, [2.0, 0.0, 1.0, 0.0, 2.0, 0.0, 0.0, 0.0, 2.0])], "frame_id bigint, h array<double>")
    seen = dual_geometry.homography_predictions(spark.createDataFrame([(1, 4.0, 6.0), (9, 1.0, 1.0)], "frame_id bigint, map_x double, map_y double"), h, (2.0, 2.0), (10.0, 10.0)).collect()
    assert {r["frame_id"]: (r["hu"], r["hv"]) for r in seen} == {1: (25.0, 30.0), 9: (None, None)}


def test_dual_geometry_shuffles_points_once(spark):
    """Points and poses meet in one join, and a frame's statistics follow from one grouping; it was a join and five windows for each kind of residual."""
    points = spark.range(40).selectExpr("id % 7 frame_id", "id * 1D u", "id * 2D v", "id + 1D hu", "id - 1D hv", "id * 1D x", "id * 1D y", "0D z", "1D score")
    pose = spark.range(7).selectExpr("id frame_id", "array(1D, 0D, 0D, 0D, -1D, 0D, 0D, 0D, -1D) r", "array(0D, 0D, 120D) t", "600D fx", "600D fy", "300D cx", "200D cy")
    plan = dual_geometry.statistics(points, pose)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line for line in plan.splitlines()) <= 3 and "Window" not in plan
