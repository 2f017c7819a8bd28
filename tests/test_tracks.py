"""Hand-made tracks: ends, ties, gaps and missing values."""

import math

import pytest
from pyspark.sql import functions as F

from fathomline.functions import angles, geo, vision
from fathomline.operators import asof, clean, evaluate, heading, matching, raster

REF = [(1, 0.0, 1, 10.0), (1, 10.0, 2, 20.0), (1, 10.0, 3, 99.0), (1, 200000.0, 4, 40.0)]
OWN = [(1, -1.0, 1), (1, 0.0, 2), (1, 5.0, 3), (1, 10.0, 4), (1, 100005.0, 5), (1, 200000.0, 6), (1, 200001.0, 7), (2, 1.0, 8), (None, 1.0, 9)]


@pytest.fixture
def series(spark):
    return spark.createDataFrame(OWN, "vehicle_id int, t double, seq int"), spark.createDataFrame(REF, "vehicle_id int, t double, seq int, x double")


def by_seq(df, field):
    return {r["seq"]: r[field] for r in df.collect()}


def test_modes_at_the_ends(series):
    own, ref = series
    closed = by_seq(asof.interpolate(own, ref, ["x"], "closed"), "ref_x")
    assert closed[1] is None and closed[2] == 10.0 and closed[3] == 15.0 and closed[4] == 20.0 and closed[7] is None and closed[8] is None and closed[9] is None
    assert closed[5] == pytest.approx(99.0 + (40.0 - 99.0) * (100005.0 - 10.0) / (200000.0 - 10.0))
    inner = by_seq(asof.interpolate(own, ref, ["x"], "inner"), "ref_x")
    assert set(inner) == {2, 3, 4, 5, 6}
    clamped = by_seq(asof.interpolate(own, ref, ["x"], "clamped"), "ref_x")
    assert clamped[1] == 10.0 and clamped[7] == 40.0 and clamped[8] is None


def test_backward_with_tolerance(series):
    own, ref = series
    out = by_seq(asof.latest(own, ref, ["x"], tolerance=6.0), "ref_x")
    assert out[1] is None and out[2] == 10.0 and out[3] == 10.0 and out[4] == 20.0 and out[5] is None and out[6] == 40.0 and out[7] == 40.0


def test_no_references(spark, series):
    own, ref = series
    assert asof.interpolate(own, ref.where("false"), ["x"], "inner").count() == 0
    assert set(by_seq(asof.latest(own, ref.where("false"), ["x"]), "ref_x").values()) == {None}


def test_angles(spark):
    row = spark.range(1).select(
        angles.wrap_to_pi(F.lit(3 * math.pi)).alias("a"), angles.wrap_to_pi(F.lit(-math.pi)).alias("b"), angles.compass_of(F.lit(math.pi)).alias("c"),
        angles.lerp_angle(F.lit(6.2), F.lit(0.1), F.lit(0.5)).alias("d"),
    ).first()
    assert row["a"] == pytest.approx(math.pi) and row["b"] == pytest.approx(math.pi) and row["c"] == pytest.approx(1.5 * math.pi)
    assert row["d"] == pytest.approx(6.2 + 0.5 * (0.1 + 2 * math.pi - 6.2))


def test_missing_values_in_gates(spark):
    nan = F.lit(float("nan"))
    row = spark.range(1).select(
        vision.reject_reason(F.lit(50), F.lit(0.5), nan, 20, 0.2, 6.0).alias("reproj"),
        vision.reject_reason(F.lit(50), nan, F.lit(1.0), 20, 0.2, 6.0).alias("ratio"),
        vision.nis_passes(nan, F.lit(1.0)).alias("nis"),
        vision.expired(F.lit(3.0), F.lit(3.0)).alias("edge"),
        geo.finite(F.lit(float("inf"))).alias("inf"),
    ).first()
    assert row["reproj"] is None and row["ratio"] == "anchor_rejected_low_inlier_ratio" and row["nis"] and not row["edge"] and not row["inf"]


def straight(n=20):
    step = math.degrees(1.0 / (geo.SEMI_MAJOR * math.cos(math.radians(34.0))))
    return [(1, k * 0.1, k, 109.0 + k * step, 34.0, 400.0) for k in range(n)]


def test_heading_of_a_straight_track(spark):
    track = spark.createDataFrame(straight(), "vehicle_id int, t double, seq int, lon double, lat double, alt double")
    rows = {r["seq"]: r for r in heading.headings(track, 15).collect()}
    assert rows[1]["v_east"] is None and not rows[1]["valid"]
    assert rows[19]["speed"] == pytest.approx(10.0, rel=0.01) and rows[19]["heading"] == pytest.approx(math.pi / 2, abs=1e-6) and rows[19]["rms"] < 1e-3


def test_jumps_and_fill(spark):
    rows = straight(10)
    rows[4] = (*rows[4][:3], 110.0, *rows[4][4:])
    rows[9] = (*rows[9][:3], 110.0, *rows[9][4:])
    track = spark.createDataFrame(rows, "vehicle_id int, t double, seq int, lon double, lat double, alt double")
    marked = clean.mark_jumps(track, 50.0)
    assert [r["seq"] for r in marked.where("NOT accepted").collect()] == [4, 9]
    lon = by_seq(clean.fill_rejected(marked), "lon")
    assert lon[4] == pytest.approx((rows[3][3] + rows[5][3]) / 2) and lon[9] == rows[8][3]


def test_throttle_and_sessions(spark):
    rows = [(1, t, k) for k, t in enumerate([0.0, 0.04, 0.05, 0.09, 0.2])]
    df = spark.createDataFrame(rows, "vehicle_id int, t double, seq int")
    assert sorted(r["seq"] for r in clean.throttle(df, 0.05).collect()) == [0, 2, 4]
    assert sorted((r["session"], r["n"]) for r in clean.sessions(df, 0.1).collect()) == [(0, 4), (1, 1)]


def test_alignment_starts_at_its_end(spark):
    e = spark.createDataFrame([(1, 0.0, 2.0, 1.0), (1, 9.999, 4.0, 1.0), (1, 10.0, 5.0, 1.0)], "vehicle_id int, since double, east double, north double")
    out = evaluate.aligned(e, evaluate.alignment(e, 10.0), 10.0).collect()
    assert len(out) == 1 and out[0]["east"] == 2.0 and out[0]["north"] == 0.0


def test_raster_bounds(spark):
    pixels = spark.createDataFrame([(r, c, float(10 * r + c) if (r, c) != (2, 2) else -1.0) for r in range(3) for c in range(3)], "row int, col int, value double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 2.0, 0.0), (4, 2.1, 0.0)], "id int, x double, y double")
    out = {r["id"]: r["sample"] for r in raster.bilinear(points, pixels, "id", "x", "y", (3, 3), nodata=-1.0).collect()}
    assert out == {1: 5.5, 3: 2.0}


def test_spacing_keeps_the_best(spark):
    rows = [(1, 1, 0.0, 0.0, 0.5), (1, 2, 1.0, 0.0, 0.9), (1, 3, 5.0, 0.0, 0.1), (2, 1, 0.0, 0.0, 0.1)]
    f = spark.createDataFrame(rows, "frame_id int, number int, x double, y double, score double")
    assert sorted((r["frame_id"], r["number"]) for r in matching.spaced(f, 2.0).collect()) == [(1, 2), (1, 3), (2, 1)]
