"""Queries of the recurrences: attitude, fusion, and the reports and sinks that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import geo, vision
from fathomline.operators import inertial
from fathomline.plans.q_tracks import DAY, rounded
from fathomline.sources.tables import SAMPLES_SQL, samples
from fathomline.streaming import fusion

#: The driver's events are hours apart.
TUNING = fusion.Tuning(max_gap=2 * DAY, reinit_gap=6 * DAY, accel_sigma=1e-9, walk_xy=0.05, walk_z=0.05, damping=1e-6, damping_z=1e-6)


def _visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir, "click")
    east, north = geo.sphere_error(F.col("lon"), F.col("lat"), F.lit(109.0), F.lit(34.0))
    return s.select("vehicle_id", "t", "seq", east.alias("east"), north.alias("north"), (F.col("alt") - 400).alias("up"), F.lit(25.0).alias("var_e"), F.lit(25.0).alias("var_n"), F.lit(9.0).alias("var_u"))


def _imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir, "error")
    return s.select("vehicle_id", "t", "seq", F.lit(0.0).alias("a_east"), F.lit(0.0).alias("a_north"), F.lit(0.0).alias("a_up"))


def t5_fusion_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered positions of every vehicle in event time."""
    return rounded(fusion.fuse(fusion.events(_imu(spark, sf_dir), _visual(spark, sf_dir)), TUNING).select("vehicle_id", "seq", "source", "east", "north", "up", "var_e", "nis"), 4)


def t10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by source."""
    return t5_fusion_filter(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def w8_attitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll, pitch and acceleration from raw inertial numbers, a tenth of a second apart."""
    s = samples(spark, sf_dir)
    imu = s.select(
        "vehicle_id", (F.col("t") / 360000).alias("t"), "seq", F.lit(0.0).alias("gx"), F.lit(0.0).alias("gy"), ((F.col("k") - 50) / 1000).alias("gz"),
        ((F.col("value") % 3) / 10).alias("ax"), F.lit(0.0).alias("ay"), F.lit(-inertial.GRAVITY).alias("az"),
    )
    return rounded(inertial.attitudes(imu).select("vehicle_id", "seq", "roll", "pitch", "a_east", "a_north", "a_up"), 5)


def g18_start_attitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean acceleration of each vehicle's first twenty samples."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("vehicle_id").orderBy("t", "seq"))
    s = samples(spark, sf_dir).withColumn("i", first).where("i <= 20")
    return rounded(s.groupBy("vehicle_id").agg(F.avg((F.col("value") % 3) / 10).alias("ax"), F.count(F.lit(1)).alias("n")))


def t21_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of the last measurement at each fix, and whether it has expired after a day."""
    from fathomline.operators import asof

    out = asof.latest(samples(spark, sf_dir, "view"), samples(spark, sf_dir, "click"), ["k"])
    age = vision.anchor_age(F.col("t"), F.col("ref_t"))
    return rounded(out.select("seq", F.when(F.col("ref_t").isNotNull(), age).alias("age"), F.when(F.col("ref_t").isNotNull(), vision.expired(age, F.lit(DAY))).alias("expired")), 3)


def j12_anchor_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchor of every fix, with gates scaled to the driver's events."""
    from fathomline.operators import anchors

    v = _visual(spark, sf_dir).join(samples(spark, sf_dir, "click").select("seq", "k"), "seq")
    given = v.select("vehicle_id", "t", "seq", "east", "north", (F.col("k") * 2).alias("used"), (F.col("k") / 100).alias("inlier_ratio"), (F.col("k") % 8).cast("double").alias("reproj"))
    gates = anchors.Gates(max_age=DAY, innovation=5000.0)
    return rounded(anchors.assign(given, samples(spark, sf_dir, "view").select("vehicle_id", "t", "seq"), gates).select("vehicle_id", "seq", "anchor_seq", "age", "rejected", "reason"))


QUERIES = {f.__name__: f for f in (j12_anchor_assignment, t5_fusion_filter, t10_sources, w8_attitude, g18_start_attitude, t21_staleness)}
ORACLES = {
    "g18_start_attitude": f"WITH {SAMPLES_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t, seq) AS i FROM samples) SELECT vehicle_id, round(avg(fmod(value, 3) / 10), 6) + 0.0 AS ax, count(*) AS n FROM f WHERE i <= 20 GROUP BY 1",
    "t21_staleness": f"WITH {SAMPLES_SQL}, f AS (SELECT * FROM samples WHERE kind = 'view'), c AS (SELECT * FROM samples WHERE kind = 'click') SELECT f.seq, round(f.t - c.t, 3) + 0.0 AS age, f.t - c.t > 86400 AS expired FROM f ASOF LEFT JOIN c ON f.vehicle_id = c.vehicle_id AND f.t >= c.t",
}
