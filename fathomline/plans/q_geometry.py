"""Queries of the two geometries of a frame, and of approximate neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import rotations as rot
from fathomline.operators import dual_geometry, matching
from fathomline.plans.q_frames import _POINTS, HEIGHT, WIDTH, points
from fathomline.plans.q_tracks import rounded
from fathomline.sources.tables import table

FOCAL = 683.71
#: Shares of the driver's residuals; odd ones, so that no rounded result lies half-way.
A, B, C = 0.97313731, 0.51371939, 0.24683177


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras of frames that look down from a little over the highest point, turned by the order's number."""
    key = F.col("o_orderkey")
    yaw, up = F.radians((key % 360).cast("double")), 120.0 + (key % 40).cast("double")
    zero, c, s = F.lit(0.0), F.cos(yaw), F.sin(yaw)
    return table(spark, sf_dir, "orders").select(
        key.alias("frame_id"), F.array(c, s, zero, s, -c, zero, zero, zero, F.lit(-1.0)).alias("r"), F.array(zero, zero, up).alias("t"),
        F.lit(FOCAL).alias("fx"), F.lit(FOCAL).alias("fy"), F.lit(WIDTH / 2).alias("cx"), F.lit(HEIGHT / 2).alias("cy"),
    )


def a39_dual_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel and ground covariance of every frame; what was seen and the homography's prediction differ from the pose's by the residuals."""
    p = points(spark, sf_dir).select("frame_id", (F.col("cam_x") - WIDTH / 2).alias("x"), (F.col("cam_y") - HEIGHT / 2).alias("y"), (F.col("alt") - 400).alias("z"), "ru", "rv", "score")
    own = poses(spark, sf_dir)
    met = p.join(own, "frame_id")
    u, v = dual_geometry.project(F.col("r"), F.col("t"), (F.col("x"), F.col("y"), F.col("z")), tuple(F.col(c) for c in ("fx", "fy", "cx", "cy")))
    seen = met.withColumns({"pu": u, "pv": v}).select("frame_id", "x", "y", "z", "score", (F.col("pu") + A * F.col("ru")).alias("u"), (F.col("pv") + A * F.col("rv")).alias("v"), (F.col("pu") + B * F.col("rv")).alias("hu"), (F.col("pv") - C * F.col("ru")).alias("hv"))
    out = dual_geometry.statistics(seen, own)
    j = rot.parts(F.col("j"), 4)
    names = ["frame_id", "shared", "rmse_h", "rmse_p", "rmse_d", "px_var_u", "px_cov_uv", "px_var_v"]
    return rounded(out.select(*names, *[c.alias(f"j{n}") for c, n in zip(j, ("11", "12", "21", "22"), strict=True)], "condition", "scale", "var_x", "var_y", "valid"), 7)


def _cov(name: str) -> str:
    return f"""
{name}k AS (SELECT frame_id, {name}u AS u, {name}v AS v, w, sqrt({name}u ** 2 + {name}v ** 2) AS len, count(*) OVER (PARTITION BY frame_id) AS n,
  row_number() OVER (PARTITION BY frame_id ORDER BY sqrt({name}u ** 2 + {name}v ** 2)) AS i FROM res),
{name}l AS (SELECT *, max(CASE WHEN i = floor(0.9::DOUBLE * (n - 1)) + 1 THEN len END) OVER (PARTITION BY frame_id) AS lim FROM {name}k),
{name}x AS (SELECT *, count(*) FILTER (len <= lim + 1e-12) OVER (PARTITION BY frame_id) AS kept FROM {name}l),
{name}m AS (SELECT *, u - median(u) OVER (PARTITION BY frame_id) AS du, v - median(v) OVER (PARTITION BY frame_id) AS dv FROM {name}x WHERE len <= lim + 1e-12 OR kept < 2),
{name}c AS (SELECT frame_id, sum(w * du * du) / sum(w) AS {name}uu, sum(w * dv * dv) / sum(w) AS {name}vv, sum(w * du * dv) / sum(w) AS {name}uv, sqrt(sum(w * (u * u + v * v)) / sum(w)) AS rmse_{name} FROM {name}m GROUP BY 1),"""


def _seen(dx: str, dy: str, axis: str) -> str:
    """Pixel of the reference point moved on the ground."""
    x = f"(cos(yaw) * (x + {dx}) + sin(yaw) * (y + {dy}))" if axis == "u" else f"(sin(yaw) * (x + {dx}) - cos(yaw) * (y + {dy}))"
    return f"{FOCAL}::DOUBLE * {x} / (up - z)"


_A39 = f"""WITH {_POINTS},
res AS (SELECT frame_id, cam_x - {WIDTH / 2}::DOUBLE AS x, cam_y - {HEIGHT / 2}::DOUBLE AS y, alt - 400 AS z, greatest(score, 0.001::DOUBLE) AS w,
  {B}::DOUBLE * rv - {A}::DOUBLE * ru AS hu, -{C}::DOUBLE * ru - {A}::DOUBLE * rv AS hv, -{A}::DOUBLE * ru AS pu, -{A}::DOUBLE * rv AS pv, -{B}::DOUBLE * rv AS du, {C}::DOUBLE * ru AS dv FROM points),
{_cov("h")}{_cov("p")}{_cov("d")}
centre AS (SELECT frame_id, count(*) AS shared, sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y, sum(w * z) / sum(w) AS z,
  radians((frame_id % 360)::DOUBLE) AS yaw, 120.0::DOUBLE + frame_id % 40 AS up FROM res GROUP BY 1),
j AS (SELECT *, ({_seen("1", "0", "u")} - {_seen("-1", "0", "u")}) / 2 AS a, ({_seen("0", "1", "u")} - {_seen("0", "-1", "u")}) / 2 AS b,
  ({_seen("1", "0", "v")} - {_seen("-1", "0", "v")}) / 2 AS c, ({_seen("0", "1", "v")} - {_seen("0", "-1", "v")}) / 2 AS d FROM centre WHERE shared >= 4),
g AS (SELECT *, d / (a * d - b * c) AS xu, -b / (a * d - b * c) AS xv, -c / (a * d - b * c) AS yu, a / (a * d - b * c) AS yv,
  huu / 4 + puu / 4 + duu / 2 + 1e-4 AS uu, huv / 4 + puv / 4 + duv / 2 AS uv, hvv / 4 + pvv / 4 + dvv / 2 + 1e-4 AS vv,
  a * a + b * b + c * c + d * d AS tr, a * d - b * c AS det FROM j JOIN hc USING (frame_id) JOIN pc USING (frame_id) JOIN dc USING (frame_id))
SELECT frame_id, n.shared, round(rmse_h, 7) + 0.0 AS rmse_h, round(rmse_p, 7) + 0.0 AS rmse_p, round(rmse_d, 7) + 0.0 AS rmse_d, round(uu, 7) + 0.0 AS px_var_u, round(uv, 7) + 0.0 AS px_cov_uv,
  round(vv, 7) + 0.0 AS px_var_v, round(a, 7) + 0.0 AS j11, round(b, 7) + 0.0 AS j12, round(c, 7) + 0.0 AS j21, round(d, 7) + 0.0 AS j22,
  round(sqrt((tr / 2 + sqrt(greatest(0, tr * tr / 4 - det * det))) / (tr / 2 - sqrt(greatest(0, tr * tr / 4 - det * det)))), 7) + 0.0 AS condition,
  round((sqrt(xu ** 2 + yu ** 2) + sqrt(xv ** 2 + yv ** 2)) / 2, 7) + 0.0 AS scale, round(xu * xu * uu + 2 * xu * xv * uv + xv * xv * vv, 7) + 0.0 AS var_x,
  round(yu * yu * uu + 2 * yu * yv * uv + yv * yv * vv, 7) + 0.0 AS var_y, g.frame_id IS NOT NULL AS valid
FROM (SELECT frame_id, count(*) AS shared FROM res GROUP BY 1) n LEFT JOIN g USING (frame_id)"""


def j15_neighbours_by_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest even descriptors of every odd one, by random-projection buckets (approximate)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    return rounded(matching.nearest_by_hashes(e.where("id % 2 = 1"), e.where("id % 2 = 0"), 2, tables=12, width=1.0, qid="id", pid="id"), 5)


QUERIES = {f.__name__: f for f in (a39_dual_geometry, j15_neighbours_by_hashes)}
ORACLES = {"a39_dual_geometry": _A39}
