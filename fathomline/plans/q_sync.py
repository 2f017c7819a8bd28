"""Query of prepared frames: fix and attitude at every frame, or why there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import sync
from fathomline.plans.q_tracks import DAY, rounded
from fathomline.sources.tables import SAMPLES_SQL, samples

#: The driver's events are hours apart: a clock shift and a patience to their scale.
SHIFT, PATIENCE = 1800.0, 3 * DAY


def t1_prepared_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    imu = samples(spark, sf_dir, "error").select("vehicle_id", "t", "seq", F.col("value").alias("roll"), F.col("k").cast("double").alias("pitch"))
    out = sync.prepare(samples(spark, sf_dir, "signup"), samples(spark, sf_dir, "view"), imu, SHIFT, PATIENCE)
    return rounded(out, 8)


def _at(name: str, field: str) -> str:
    between = f"{name}0.{field} + (q.{name}_t - {name}0.t) / ({name}1.t - {name}0.t) * ({name}1.{field} - {name}0.{field})"
    known = f"{name}1.t IS NOT NULL AND {name}1.t - q.{name}_t <= {PATIENCE}::DOUBLE AND ({name}0.t IS NOT NULL OR {name}1.t = q.{name}_t)"
    return f"round(CASE WHEN {known} THEN CASE WHEN {name}1.t = q.{name}_t THEN {name}1.{field} ELSE {between} END END, 8) + 0.0 AS {field}"


def _late(name: str) -> str:
    return f"{name}1.t IS NULL OR {name}1.t - q.{name}_t > {PATIENCE}::DOUBLE"


def _early(name: str) -> str:
    return f"{name}0.t IS NULL AND {name}1.t <> q.{name}_t"


_T1 = f"""WITH {SAMPLES_SQL}, fix AS (SELECT vehicle_id, t, lon, lat, alt FROM samples WHERE kind = 'view'),
imu AS (SELECT vehicle_id, t, value AS roll, k::DOUBLE AS pitch FROM samples WHERE kind = 'error'),
q AS (SELECT vehicle_id, t, seq, t AS fix_t, t + {SHIFT}::DOUBLE AS imu_t FROM samples WHERE kind = 'signup')
SELECT q.vehicle_id, round(q.t, 8) + 0.0 AS t, q.seq, {", ".join([*[_at("fix", f) for f in sync.FIX], *[_at("imu", f) for f in sync.IMU]])},
  CASE WHEN {_late("fix")} THEN 'waiting_for_future_gps_on_shutdown' WHEN {_late("imu")} THEN 'waiting_for_future_imu_on_shutdown'
       WHEN {_early("fix")} THEN 'image_before_oldest_fix' WHEN {_early("imu")} THEN 'imu_query_before_tracker_start' END AS failure_reason
FROM q ASOF LEFT JOIN fix fix1 ON q.vehicle_id = fix1.vehicle_id AND q.fix_t <= fix1.t
ASOF LEFT JOIN fix fix0 ON q.vehicle_id = fix0.vehicle_id AND q.fix_t > fix0.t
ASOF LEFT JOIN imu imu1 ON q.vehicle_id = imu1.vehicle_id AND q.imu_t <= imu1.t
ASOF LEFT JOIN imu imu0 ON q.vehicle_id = imu0.vehicle_id AND q.imu_t > imu0.t"""

QUERIES = {"t1_prepared_frames": t1_prepared_frames}
ORACLES = {"t1_prepared_frames": _T1}
