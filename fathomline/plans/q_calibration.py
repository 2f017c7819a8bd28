"""Queries of camera and run files: a text for every image, written from its row, and what is read back from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.sources import calibration
from fathomline.sources.tables import SAMPLES_SQL, samples


def _texts(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    rows = samples(spark, sf_dir, "signup").where("k IS NOT NULL")
    return rows.select("vehicle_id", "seq", text.alias("text"))


def s15_extrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.when(F.col("k") % 7 == 0, "").otherwise(" [ 0. 0. 0. 1. ]]\n")
    matrix = F.format_string("T_ci:  (imu0 to cam0):\n[[1 2 3 4]\nT_ic:  (cam0 to imu0):\n[[%d.5 0 -1 %d.25]\n [0, 1, 0, -%d.125]\n [ 1e-1 0 1 %d]\n", "k", "k", "k", "seq")
    shift = F.when(F.col("k") % 11 == 0, "").otherwise(F.format_string("\ntimeshift cam0 to imu0:\n\n-0.%d5\n", F.col("k") % 10))
    out = _texts(spark, sf_dir, F.concat(matrix, last, shift)).withColumn("c", calibration.extrinsics(F.col("text")))
    own = [F.get("c.rotation", F.lit(k)).alias(f"r{k}") for k in (0, 2, 6)] + [F.get("c.translation", F.lit(k)).alias(f"t{k}") for k in range(3)]
    return out.select("vehicle_id", "seq", *own, "c.shift", "c.reason")


_WHOLE = "CASE WHEN k % 7 <> 0 AND k % 11 <> 0 THEN {} END AS {}"
_S15 = f"""WITH {SAMPLES_SQL} SELECT vehicle_id, seq, {", ".join(_WHOLE.format(v, n) for v, n in (
    ("k + 0.5::DOUBLE", "r0"), ("-1.0::DOUBLE", "r2"), ("0.1::DOUBLE", "r6"), ("k + 0.25::DOUBLE", "t0"), ("-(k + 0.125::DOUBLE)", "t1"), ("seq::DOUBLE", "t2"),
    ("('-0.' || (k % 10) || '5')::DOUBLE", "shift")))},
  CASE WHEN k % 7 = 0 THEN 'T_ic_incomplete' WHEN k % 11 = 0 THEN 'timeshift_missing' END AS reason FROM samples WHERE kind = 'signup' AND k IS NOT NULL"""


def s14_intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.format_string("intrinsics: [%d.5, 401,\n 3.2e2, 240]\ndistortion_coeffs: [0.5, %d, 0, -0.25, 7]\n", "k", "seq")
    block = F.format_string("cam0:\n  intrinsics:\n  - %d.5\n  - 401\n  - 320.0\n  - 240\n  distortion_coeffs: [0.5, %d, 0, -0.25]\n  resolution: [640, 480]\n", "k", "seq")
    short = F.format_string("intrinsics: [%d, 2, 3]\n", "k")
    text = F.when(F.col("k") % 9 == 0, short).when(F.col("k") % 2 == 0, flat).otherwise(block)
    out = _texts(spark, sf_dir, text).withColumn("c", calibration.intrinsics(F.col("text")))
    return out.select("vehicle_id", "seq", "c.fx", "c.cx", F.get("c.distortion", F.lit(1)).alias("d1"), F.get("c.distortion", F.lit(3)).alias("d3"), "c.width", "c.height", "c.reason")


_FULL = "CASE WHEN k % 9 <> 0 THEN {} END AS {}"
_S14 = f"""WITH {SAMPLES_SQL} SELECT vehicle_id, seq, {", ".join(_FULL.format(v, n) for v, n in (
    ("k + 0.5::DOUBLE", "fx"), ("320.0::DOUBLE", "cx"), ("seq::DOUBLE", "d1"), ("-0.25::DOUBLE", "d3"),
    ("CASE WHEN k % 2 = 0 THEN 0 ELSE 640 END::INT", "width"), ("CASE WHEN k % 2 = 0 THEN 0 ELSE 480 END::INT", "height")))},
  CASE WHEN k % 9 = 0 THEN 'intrinsics_missing' END AS reason FROM samples WHERE kind = 'signup' AND k IS NOT NULL"""


def s13_run_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(F.col("k") % 5 == 0, "orb").otherwise("superpoint")
    model = F.when(F.col("k") % 6 == 0, "models").otherwise("model")
    text = F.format_string(
        "input:\n  image0: a%d.png # first\n  image1: 'b.png'\n%s:\n  superpoint: s\n  lightglue: l\noutput:\n  matches: out/m%d.png\nruntime:\n  max_draw: %d\nmatching:\n  ratio: 0.%d\nfeature:\n  method: %s\n",
        "seq", model, "seq", F.col("k") - 50, F.col("k") % 10, method,
    )
    out = _texts(spark, sf_dir, text).withColumn("c", calibration.run_configuration(F.col("text")))
    names = {"dem": "input.dem_tif", "draw": "runtime.max_draw", "ratio": "matching.ratio", "report": "output.pnp_report", "warp": "output.warp"}
    return out.select("vehicle_id", "seq", *[F.element_at("c.values", k).alias(n) for n, k in names.items()], "c.reason")


_GOOD = "CASE WHEN k % 6 <> 0 AND k % 5 <> 0 THEN {} END AS {}"
_S13 = f"""WITH {SAMPLES_SQL} SELECT vehicle_id, seq, {", ".join(_GOOD.format(v, n) for v, n in (
    ("'a' || seq || '.png'", "dem"), ("CASE WHEN k > 50 THEN (k - 50)::VARCHAR ELSE '200' END", "draw"), ("CASE WHEN k % 10 = 0 THEN '0.8' ELSE '0.' || (k % 10) END", "ratio"),
    ("'out/m' || seq || '_pnp.txt'", "report"), ("'out/m' || seq || '_warp.png'", "warp")))},
  CASE WHEN k % 6 = 0 THEN 'section_missing' WHEN k % 5 = 0 THEN 'lightglue_needs_superpoint' END AS reason FROM samples WHERE kind = 'signup' AND k IS NOT NULL"""

QUERIES = {"s13_run_configuration": s13_run_configuration, "s14_intrinsics": s14_intrinsics, "s15_extrinsics": s15_extrinsics}
ORACLES = {"s13_run_configuration": _S13, "s14_intrinsics": _S14, "s15_extrinsics": _S15}
