"""Null keys in folds; values that are not finite in frame statistics."""

from fathomline.operators import clean, frames

NAN, INF = float("nan"), float("inf")


def test_null_keys_are_one_key(spark):
    rows = [(k, t, float(t)) for k in (None, 7) for t in range(4)]
    df = spark.createDataFrame(rows, "vehicle_id bigint, seq bigint, t double")
    got = sorted((r["vehicle_id"] or 0, r["t"]) for r in clean.throttle(df, 2.0).collect())
    assert got == [(0, 0.0), (0, 2.0), (7, 0.0), (7, 2.0)]


def test_values_that_are_not_finite_are_left_out(spark):
    clean_rows = [(1, float(x), float(-x), 1.0) for x in range(4)]
    odd = [(1, NAN, 1.0, 1.0), (1, INF, 1.0, 1.0), (1, 1.0, None, 1.0), (1, 1.0, 1.0, NAN)]
    schema = "frame_id bigint, u double, v double, w double"
    plain, mixed = (frames.robust_covariance(spark.createDataFrame(r, schema), "u", "v", "w").collect() for r in (clean_rows, clean_rows + odd))
    assert plain == mixed
    heights = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, INF), (1, NAN), (1, None)], "frame_id bigint, alt double")
    (row,) = frames.terrain(heights).collect()
    assert (row["n"], row["relief"], row["median"]) == (2, 2.0, 2.0)
    (row,) = frames.quantiles(heights, "alt", 0.9).collect()
    assert (row["n"], row["quantile"]) == (2, 1.0)


def test_positions_that_are_not_finite_are_never_a_reference(spark):
    rows = [("a", float(k), k, lon, 34.0, 400.0) for k, lon in enumerate([NAN, 109.0, None, 109.0, INF, 110.0, 109.0001])]
    df = spark.createDataFrame(rows, "vehicle_id string, t double, seq bigint, lon double, lat double, alt double")
    got = [r["accepted"] for r in clean.mark_jumps(df, 100.0).orderBy("t").collect()]
    assert got == [False, True, False, True, False, False, True]
    filled = [r["lon"] for r in clean.fill_rejected(clean.mark_jumps(df, 100.0)).orderBy("t").collect()]
    assert filled[0] == filled[2] == 109.0 and all(109.0 <= x <= 109.0001 for x in filled)
