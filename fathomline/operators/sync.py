"""Frames prepared from the two series that they wait for: a fix and an attitude on either side of the frame.

A frame of time t needs the fixes around t and the inertial rows around t + shift (the camera's clock against the inertial one).
The reason why a frame can't be prepared is the first that holds:

* waiting_for_future_gps_on_shutdown: no fix at t or within patience seconds after it;
* waiting_for_future_imu_on_shutdown: the same of inertial rows and t + shift;
* image_before_oldest_fix: no fix before t and none at t;
* imu_query_before_tracker_start: no inertial row before t + shift and none at it.

Otherwise it is null and all fields are interpolated; whatever a reason leaves known is filled in.  Rows of fixes and imu whose time
or any field isn't finite are passed over, and frames without a time are dropped; equal times are taken in the order of seq;
repeated frames get equal rows; a null key is a key.

`prepare` is a batch job of as-of joins.  `fathomline.streaming.sync.prepare_stream` gives the same rows from a stream, whatever its micro-batches are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.geo import finite
from fathomline.operators import asof

FIX, IMU = ("lon", "lat", "alt"), ("roll", "pitch")
NO_FIX, NO_IMU = "waiting_for_future_gps_on_shutdown", "waiting_for_future_imu_on_shutdown"
EARLY_FIX, EARLY_IMU = "image_before_oldest_fix", "imu_query_before_tracker_start"
FOREVER = 1e300


def sound(refs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    return refs.where(finite(F.col("t"), *map(F.col, fields)))


def _side(rows: DataFrame, refs: DataFrame, fields: tuple[str, ...], at: str, name: str, patience: float, by: str, width: float) -> DataFrame:
    """rows with _late and _early of a series, and its fields at the time in column `at`."""
    moved = refs.withColumn(at, F.col("t")) if at != "t" else refs
    near = asof.neighbours(rows, moved, list(fields), by=by, t=at, width=width)
    late = F.col("after").isNull() | (F.col("after.t") - F.col(at) > patience)
    hit = F.col("after.t") == F.col(at)
    early = F.col("before").isNull() & ~F.coalesce(hit, F.lit(False))
    between = lambda f: F.when(hit, F.col(f"after.{f}")).otherwise(F.col(f"before.{f}") + asof.share(F.col(at)) * (F.col(f"after.{f}") - F.col(f"before.{f}")))
    values = {f: F.when(~late & ~early, between(f)) for f in fields}
    return near.withColumns({f"_{name}_late": late, f"_{name}_early": early, **values}).drop("before", "after")


def prepare(frames: DataFrame, fixes: DataFrame, imu: DataFrame, shift: float = 0.0, patience: float = FOREVER, by: str = "vehicle_id", width: float = 86400.0) -> DataFrame:
    """by, t, seq of frames with lon, lat, alt, roll, pitch and failure_reason."""
    rows = frames.where(finite(F.col("t"))).select(by, "t", "seq", (F.col("t") + shift).alias("imu_t"))
    rows = _side(rows, sound(fixes, FIX), FIX, "t", "fix", patience, by, width)
    rows = _side(rows, sound(imu, IMU), IMU, "imu_t", "imu", patience, by, width)
    reason = F.when(F.col("_fix_late"), NO_FIX).when(F.col("_imu_late"), NO_IMU).when(F.col("_fix_early"), EARLY_FIX).when(F.col("_imu_early"), EARLY_IMU)
    return rows.select(by, "t", "seq", *FIX, *IMU, reason.alias("failure_reason"))
