"""Queries over frames, rasters and descriptors: statistics, covariance models, gates, matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import geo, vision
from fathomline.functions.decimals import rounded_to
from fathomline.functions.geo import Geo
from fathomline.operators import frames, matching, raster
from fathomline.plans.q_tracks import rounded
from fathomline.sources.tables import SAMPLES_SQL, samples, table

WIDTH, HEIGHT = 752, 480


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched points of frames from lineitem."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_orderkey").alias("frame_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        (F.col("l_extendedprice") % WIDTH).alias("cam_x"),
        (F.col("l_partkey") % HEIGHT).cast("double").alias("cam_y"),
        (400.0 + F.col("l_quantity")).alias("alt"),
        ((F.col("l_discount") - 0.05) * 40.0).alias("ru"),
        ((F.col("l_tax") - 0.04) * 40.0).alias("rv"),
        (F.col("l_quantity") / 50.0).alias("score"),
    )


_POINTS = f"""points AS (SELECT l_orderkey AS frame_id, l_linenumber AS line, l_partkey AS part, fmod(l_extendedprice::DOUBLE, {WIDTH}) AS cam_x, (l_partkey % {HEIGHT})::DOUBLE AS cam_y,
  400.0::DOUBLE + l_quantity AS alt, (l_discount::DOUBLE - 0.05::DOUBLE) * 40 AS ru, (l_tax::DOUBLE - 0.04::DOUBLE) * 40 AS rv, l_quantity::DOUBLE / 50 AS score FROM lineitem)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vision results of frames from orders."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        key.alias("frame_id"),
        (F.col("o_custkey") % 200).alias("used"),
        ((key % 100) / 100.0).alias("inlier_ratio"),
        F.when(key % 17 != 0, price % 8).alias("reproj"),
        (price % 50 + 1).alias("nis"),
        (key % 7 * 0.1 + 0.2).alias("spread"),
        (price % 90 + 10).alias("depth"),
        (key % 40 + 1.0).alias("obliqueness"),
        (price % 3 + 0.5).alias("var_x"),
        F.when(key % 11 != 0, price % 5 + 0.5).alias("var_y"),
        (key % 30 + 2.0).alias("relief"),
    )


_RESULTS = """results AS (SELECT o_orderkey AS frame_id, o_custkey % 200 AS used, (o_orderkey % 100) / 100.0::DOUBLE AS inlier_ratio,
  CASE WHEN o_orderkey % 17 <> 0 THEN fmod(o_totalprice::DOUBLE, 8) END AS reproj, fmod(o_totalprice::DOUBLE, 50) + 1 AS nis, o_orderkey % 7 * 0.1::DOUBLE + 0.2::DOUBLE AS spread,
  fmod(o_totalprice::DOUBLE, 90) + 10 AS depth, o_orderkey % 40 + 1.0::DOUBLE AS obliqueness, fmod(o_totalprice::DOUBLE, 3) + 0.5::DOUBLE AS var_x,
  CASE WHEN o_orderkey % 11 <> 0 THEN fmod(o_totalprice::DOUBLE, 5) + 0.5::DOUBLE END AS var_y, o_orderkey % 30 + 2.0::DOUBLE AS relief FROM orders)"""


def g4_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames.terrain(points(spark, sf_dir)))


def g5_floor_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("len", rounded_to(F.hypot("ru", "rv"), 9))
    return rounded(frames.quantiles(p, "len", 0.9))


def g6_robust_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames.robust_covariance(points(spark, sf_dir), "ru", "rv", "score"), 5)


_G6 = f"""WITH {_POINTS}, u AS (SELECT frame_id, ru AS u, rv AS v, score AS w, sqrt(ru * ru + rv * rv) AS len FROM points WHERE score > 0),
k AS (SELECT *, count(*) OVER (PARTITION BY frame_id) AS n, row_number() OVER (PARTITION BY frame_id ORDER BY len) AS r FROM u),
l AS (SELECT *, max(CASE WHEN r = floor(0.9::DOUBLE * (n - 1)) + 1 THEN len END) OVER (PARTITION BY frame_id) AS lim FROM k),
c AS (SELECT *, count(*) FILTER (len <= lim + 1e-12) OVER (PARTITION BY frame_id) AS kept FROM l),
x AS (SELECT * FROM c WHERE len <= lim + 1e-12 OR kept < 2),
m AS (SELECT *, u - median(u) OVER (PARTITION BY frame_id) AS du, v - median(v) OVER (PARTITION BY frame_id) AS dv FROM x)
SELECT frame_id, max(n) AS n, count(*) AS kept, round(sum(w * du * du) / sum(w), 5) + 0.0 AS var_u, round(sum(w * dv * dv) / sum(w), 5) + 0.0 AS var_v,
  round(sum(w * du * dv) / sum(w), 5) + 0.0 AS cov_uv, round(sqrt(sum(w * (u * u + v * v)) / sum(w)), 5) + 0.0 AS rmse FROM m GROUP BY 1"""


def g7_point_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames.spread(points(spark, sf_dir), "cam_x", "cam_y", float(WIDTH * HEIGHT)))


def g8_depth_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.sqrt(F.pow(F.col("cam_x") - 376.0, 2) + F.pow(F.col("cam_y") - 240.0, 2) + F.pow("alt", 2))
    return rounded(frames.depth_spread(points(spark, sf_dir).withColumn("d", d), "d"), 5)


def g9_reprojection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames.reprojection(points(spark, sf_dir), "ru", "rv"))


def g10_reference_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames.reference_point(points(spark, sf_dir), "cam_x", "cam_y", "score"), 5)


def g13_source_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, visual updates and failed gates by source."""
    r = results(spark, sf_dir)
    reason = vision.reject_reason(F.col("used"), F.col("inlier_ratio"), F.col("reproj"), 20, 0.2, 6.0)
    source = F.when(reason.isNotNull(), F.concat(F.lit("anchor_rejected_"), reason)).when(vision.nis_passes(F.col("nis"), F.lit(16.266)), "visual_update").otherwise("visual_reject_nis")
    out = r.select(source.alias("source"), "nis").groupBy("source")
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), F.avg("nis").alias("mean_nis")))


_REASON = "CASE WHEN used < 20 THEN 'anchor_rejected_low_used_points' WHEN inlier_ratio IS NULL OR inlier_ratio < 0.2 THEN 'anchor_rejected_low_inlier_ratio' WHEN reproj > 6 THEN 'anchor_rejected_high_reproj_error' END"


def g15_summary_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages over finite values, 0 where there are none."""
    names = ["reproj", "nis", "depth", "var_y"]
    return rounded(results(spark, sf_dir).agg(*[F.coalesce(F.avg(geo.null_if_not_finite(F.col(c))), F.lit(0.0)).alias(c) for c in names]))


def f2_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = vision.reject_reason(F.col("used"), F.col("inlier_ratio"), F.col("reproj"), 20, 0.2, 6.0)
    return results(spark, sf_dir).select("frame_id", reason.alias("reason"), vision.nis_passes(F.col("nis"), F.lit(16.266)).alias("nis_ok"))


def a26_axis_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted variances, and the measurement variances chosen from them."""
    values = {c: F.col(c) for c in ("reproj", "spread", "depth", "obliqueness", "relief")}
    values |= {"pnp_rate": F.col("inlier_ratio"), "homography_rate": F.col("inlier_ratio"), "h_rmse": F.col("var_x"), "inliers": F.col("used").cast("double")}
    predicted = vision.axis_variances(values, F.col("var_x"), F.col("var_y"))
    chosen = vision.measurement_variances(predicted, F.col("var_x"), F.col("var_y"), F.col("spread"), 3.0, 2.0)
    names = ["pred_x", "pred_y", "pred_z", "meas_x", "meas_y", "meas_z"]
    out = results(spark, sf_dir).select("frame_id", *[c.alias(n) for n, c in zip(names, [*predicted, *chosen], strict=True)])
    # relative digits: the altitude model spans many magnitudes
    return out.select("frame_id", *[F.when(F.col(n).isNotNull(), F.format_string("%.6e", n)).alias(n) if n.endswith("z") else (rounded_to(F.col(n), 6) + 0.0).alias(n) for n in names])


def _trend_sql(trend: tuple, clip: tuple) -> str:
    names = {"pnp_rate": "inlier_ratio", "homography_rate": "inlier_ratio", "h_rmse": "var_x"}
    logs = " + ".join(f"{slope!r}::DOUBLE * ln(nullif({names.get(n, n)}, 0) / {ref!r}::DOUBLE)" for n, ref, slope in trend)
    ok = " AND ".join(f"{names.get(n, n)} > 0" for n, _, _ in trend)
    return f"CASE WHEN {ok} THEN greatest({clip[0]}::DOUBLE, least({clip[1]}::DOUBLE, exp({logs}))) END"


_Z = (
    f"exp({vision.Z_INTERCEPT!r}::DOUBLE + {vision.Z_WEIGHTS['reproj']!r}::DOUBLE * ln(CASE WHEN reproj > 0 THEN greatest(reproj, 1e-6) END)"
    f" + {vision.Z_WEIGHTS['relief']!r}::DOUBLE * ln(relief) + {vision.Z_WEIGHTS['inliers']!r}::DOUBLE * ln(1 + used)"
    f" + {vision.Z_WEIGHTS['pnp_rate']!r}::DOUBLE * ln(CASE WHEN inlier_ratio > 0 THEN greatest(inlier_ratio, 1e-6) END))"
)
_A26 = f"""WITH {_RESULTS}, p AS (SELECT *, var_x * {_trend_sql(vision.X_TREND, vision.X_CLIP)} AS px, var_y * {_trend_sql(vision.Y_TREND, vision.Y_CLIP)} AS py, {_Z} AS pz FROM results)
SELECT frame_id, round(px, 6) + 0.0 AS pred_x, round(py, 6) + 0.0 AS pred_y, CASE WHEN pz IS NULL THEN NULL ELSE printf('%.6e', pz) END AS pred_z,
  round(CASE WHEN px > 0 THEN greatest(px, 9) WHEN var_x > 0 THEN greatest(var_x, 9) ELSE 9 END, 6) + 0.0 AS meas_x,
  round(CASE WHEN py > 0 THEN greatest(py, 9) WHEN var_y > 0 THEN greatest(var_y, 9) ELSE 9 END, 6) + 0.0 AS meas_y,
  printf('%.6e', CASE WHEN pz > 0 THEN greatest(pz, 4) ELSE greatest(4, pow(4 * spread, 2)) END) AS meas_z FROM p"""


def a23_nis(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.col("var_x") - 2.0, F.col("depth") / 50.0, F.col("spread"))
    s = (F.col("var_x") + 1.0, F.lit(0.1), F.lit(0.05), F.col("nis"), F.lit(0.2), F.col("relief"))
    return rounded(results(spark, sf_dir).select("frame_id", vision.nis3(v, s).alias("nis3")))


_A23 = f"""WITH {_RESULTS}, q AS (SELECT frame_id, var_x - 2 AS x, depth / 50 AS y, spread AS z, var_x + 1 AS xx, 0.1::DOUBLE AS xy, 0.05::DOUBLE AS xz, nis AS yy, 0.2::DOUBLE AS yz, relief AS zz FROM results),
l AS (SELECT *, sqrt(xx) AS l11, xy / sqrt(xx) AS l21, xz / sqrt(xx) AS l31 FROM q), m AS (SELECT *, sqrt(yy - l21 * l21) AS l22 FROM l),
o AS (SELECT *, (yz - l31 * l21) / l22 AS l32 FROM m), r AS (SELECT *, sqrt(zz - l31 * l31 - l32 * l32) AS l33, x / l11 AS a FROM o),
s AS (SELECT *, (y - l21 * a) / l22 AS b FROM r)
SELECT frame_id, round(a * a + b * b + pow((z - l31 * a - l32 * b) / l33, 2), 6) AS nis3 FROM s"""


def a4_local_enu(spark: SparkSession, sf_dir: str) -> DataFrame:
    east, north = geo.local_delta(F.lit(34.0), F.lit(109.0), F.col("lat"), F.col("lon"))
    return rounded(samples(spark, sf_dir, "view").select("seq", east.alias("east"), north.alias("north")))


_A4 = f"""WITH {SAMPLES_SQL}, w AS (SELECT *, 1 - 6.69437999014e-3::DOUBLE * pow(sin(radians(34.0::DOUBLE)), 2) AS w2 FROM samples WHERE kind = 'view')
SELECT seq, round(radians(lon - 109) * 6378137.0::DOUBLE / sqrt(w2) * cos(radians(34.0::DOUBLE)), 6) AS east, round(radians(lat - 34) * 6378137.0::DOUBLE * (1 - 6.69437999014e-3::DOUBLE) / (w2 * sqrt(w2)), 6) AS north FROM w"""


def _own(df: DataFrame) -> Geo:
    return Geo(F.col("lon"), F.col("lat"), F.col("alt"))


def a5_ecef_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir, "view")
    p = geo.to_ecef(_own(s))
    back = geo.from_ecef(p)
    return rounded(s.select("seq", p.x.alias("x"), p.y.alias("y"), p.z.alias("z"), rounded_to(back.lon, 8).alias("lon"), rounded_to(back.lat, 8).alias("lat"), rounded_to(back.alt, 3).alias("alt")), 4)


_A5 = f"""WITH {SAMPLES_SQL}, f AS (SELECT *, 1 / 298.257223563::DOUBLE * (2 - 1 / 298.257223563::DOUBLE) AS e2 FROM samples WHERE kind = 'view'),
n AS (SELECT *, 6378137.0::DOUBLE / sqrt(1 - e2 * pow(sin(radians(lat)), 2)) AS n FROM f)
SELECT seq, round((n + alt) * cos(radians(lat)) * cos(radians(lon)), 4) AS x, round((n + alt) * cos(radians(lat)) * sin(radians(lon)), 4) AS y, round((n * (1 - e2) + alt) * sin(radians(lat)), 4) AS z,
  round(round(lon, 8), 4) AS lon, round(round(lat, 8), 4) AS lat, round(round(alt, 3), 4) AS alt FROM n"""


def a10_shift_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point moved by metres, and the distance it then has."""
    s = samples(spark, sf_dir, "view")
    moved = geo.shift(_own(s), geo.Enu(F.lit(30.0), F.lit(40.0), F.lit(5.0)))
    return s.select("seq", rounded_to(geo.horizontal_distance(_own(s), moved), 3).alias("metres"), rounded_to(moved.alt - F.col("alt"), 6).alias("climb"))


def a13_sphere_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    east, north = geo.sphere_error(F.col("lon"), F.col("lat"), F.lit(109.1), F.lit(34.1))
    return rounded(samples(spark, sf_dir, "view").select("seq", east.alias("east"), north.alias("north")))


def a17_field_of_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of view and the half extent of the crop seen from each position."""
    h, v = geo.field_of_view(F.lit(float(WIDTH)), F.lit(float(HEIGHT)), F.lit(120.1))
    out = samples(spark, sf_dir, "view").select("seq", h.alias("hfov"), v.alias("vfov"), geo.crop_half_extent(F.col("alt"), F.lit(420.0), h, F.lit(300.0), F.lit(1.2)).alias("half"))
    return rounded(out, 5)


_A17 = f"""WITH {SAMPLES_SQL}, f AS (SELECT *, degrees(2 * atan(752 / sqrt(752.0::DOUBLE * 752 + 480 * 480) * tan(radians(120.1::DOUBLE) / 2))) AS hfov,
  degrees(2 * atan(480 / sqrt(752.0::DOUBLE * 752 + 480 * 480) * tan(radians(120.1::DOUBLE) / 2))) AS vfov FROM samples WHERE kind = 'view')
SELECT seq, round(hfov, 5) AS hfov, round(vfov, 5) AS vfov, round(greatest(1, greatest(1, alt - 420) * tan(radians(hfov) / 2) * 1.2::DOUBLE), 5) AS half FROM f"""


def o3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    order: list[Column] = [F.desc("score"), F.col("part"), F.col("line"), F.col("cam_x")]
    return frames.top_k(points(spark, sf_dir), order, 3).select("frame_id", F.col("rank").cast("long").alias("rank"), "part", "score")


def o6_spaced_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("frame_id", (F.col("part") * 100000 + F.round(F.col("cam_x") * 100).cast("long")).alias("number"), F.col("cam_x").alias("x"), F.col("cam_y").alias("y"), "score")
    return matching.spaced(p, 100.0).select("frame_id", "number", "score")


def j14_knn_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors with odd numbers matched to those with even ones by the ratio test."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    near = matching.nearest(e.where("id % 2 = 1"), e.where("id % 2 = 0"), 2, "id", "id")
    return rounded(matching.ratio_matches(near, 0.98), 5)


_J14 = """WITH d AS (SELECT a.vec_id::BIGINT AS q, b.vec_id::BIGINT AS p, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(x[1]::DOUBLE - x[2]::DOUBLE, 2)))) AS distance
  FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 1 AND b.vec_id % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, p) AS k FROM d)
SELECT a.q, a.p, round(a.distance, 5) AS distance, round(1 / (1 + a.distance), 5) AS score FROM r a LEFT JOIN r b ON a.q = b.q AND b.k = 2 WHERE a.k = 1 AND (b.distance IS NULL OR a.distance < 0.98::DOUBLE * b.distance)"""


def j14_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    odd, even = e.where("id % 2 = 1"), e.where("id % 2 = 0")
    return rounded(matching.mutual_matches(matching.nearest(odd, even, 1, "id", "id"), matching.nearest(even, odd, 1, "id", "id")), 5)


_J14M = """WITH d AS (SELECT a.vec_id::BIGINT AS q, b.vec_id::BIGINT AS p, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(x[1]::DOUBLE - x[2]::DOUBLE, 2)))) AS distance
  FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 1 AND b.vec_id % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, p) AS i, row_number() OVER (PARTITION BY p ORDER BY distance, q) AS j FROM d)
SELECT q, p, round(distance, 5) AS distance FROM r WHERE i = 1 AND j = 1"""


def j17_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points sampled from the raster of part prices, 20 pixels wide."""
    part = table(spark, sf_dir, "part")
    pixels = part.select(F.floor(F.col("p_partkey") / 20).alias("row"), (F.col("p_partkey") % 20).alias("col"), F.col("p_retailprice").alias("value"))
    height = int(part.agg(F.max("p_partkey")).first()[0]) // 20 + 1
    at = samples(spark, sf_dir, "click").select("seq", (F.col("k") * 0.21).alias("x"), (F.col("value") % 30).alias("y"))
    return rounded(raster.bilinear(at, pixels, "seq", "x", "y", (height, 20)).select("seq", "sample"), 4)


_J17 = f"""WITH {SAMPLES_SQL}, pt AS (SELECT seq, k * 0.21::DOUBLE AS x, fmod(value, 30) AS y FROM samples WHERE kind = 'click'),
px AS (SELECT p_partkey // 20 AS r, p_partkey % 20 AS c, p_retailprice::DOUBLE AS v FROM part), h AS (SELECT max(p_partkey) // 20 + 1 AS hgt FROM part),
q AS (SELECT seq, x, y, least(floor(x), 18)::BIGINT AS c0, least(floor(y), hgt - 2)::BIGINT AS r0 FROM pt, h WHERE x BETWEEN 0 AND 19 AND y BETWEEN 0 AND hgt - 1)
SELECT seq, round((1 - (x - c0)) * (1 - (y - r0)) * a.v + (x - c0) * (1 - (y - r0)) * b.v + (1 - (x - c0)) * (y - r0) * d.v + (x - c0) * (y - r0) * e.v, 4) AS sample
FROM q JOIN px a ON a.r = r0 AND a.c = c0 JOIN px b ON b.r = r0 AND b.c = c0 + 1 JOIN px d ON d.r = r0 + 1 AND d.c = c0 JOIN px e ON e.r = r0 + 1 AND e.c = c0 + 1"""


def j19_box_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir, "view").select("seq", (F.col("lon") - 0.01).alias("west"), (F.col("lat") - 0.01).alias("south"), (F.col("lon") + 0.01).alias("east"), (F.col("lat") + 0.01).alias("north"))
    return raster.box_windows(s, (109.0, 0.001, 0.0, 34.2, 0.0, -0.001), 300, 250).select("seq", "x0", "y0", "x1", "y1")


_J19 = f"""WITH {SAMPLES_SQL}, b AS (SELECT seq, floor((lon - 0.01::DOUBLE - 109) / 0.001::DOUBLE)::BIGINT AS a, ceil((lon + 0.01::DOUBLE - 109) / 0.001::DOUBLE)::BIGINT AS c,
  floor((34.2::DOUBLE - (lat + 0.01::DOUBLE)) / 0.001::DOUBLE)::BIGINT AS d, ceil((34.2::DOUBLE - (lat - 0.01::DOUBLE)) / 0.001::DOUBLE)::BIGINT AS e FROM samples WHERE kind = 'view'),
w AS (SELECT seq, greatest(0, least(a, 299)) AS x0, greatest(0, least(d, 249)) AS y0, c, e FROM b)
SELECT seq, x0, y0, greatest(x0 + 1, least(c, 300)) AS x1, greatest(y0 + 1, least(e, 250)) AS y1 FROM w"""


def o10_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("value"))
    return raster.stretch(part).select("p_partkey", "grey")


_O10 = """WITH s AS (SELECT list(p_retailprice::DOUBLE ORDER BY p_retailprice) AS l, count(*) AS n FROM part),
q AS (SELECT l[floor(0.01::DOUBLE * (n - 1))::BIGINT + 1] AS lo, l[floor(0.99::DOUBLE * (n - 1))::BIGINT + 1] AS hi FROM s)
SELECT p_partkey, CAST(round(255 * greatest(0, least(1, (p_retailprice - lo) / (hi - lo)))) AS INTEGER) AS grey FROM part, q"""

QUERIES = {
    f.__name__: f
    for f in (
        g4_terrain, g5_floor_quantile, g6_robust_covariance, g7_point_spread, g8_depth_spread, g9_reprojection, g10_reference_point, g13_source_histogram, g15_summary_averages,
        f2_quality_gate, a26_axis_variances, a23_nis, a4_local_enu, a5_ecef_round_trip, a10_shift_round_trip, a13_sphere_error, a17_field_of_view, o3_top_k, o6_spaced_features,
        j14_knn_ratio, j14_mutual, j17_bilinear, j19_box_windows, o10_stretch,
    )
}
ORACLES = {
    "g4_terrain": f"WITH {_POINTS} SELECT frame_id, count(alt) AS n, round(max(alt) - min(alt), 6) AS relief, round(stddev_pop(alt), 6) AS std, round(median(alt), 6) AS median FROM points GROUP BY 1",
    "g5_floor_quantile": f"WITH {_POINTS}, l AS (SELECT frame_id, list_sort(list(round(sqrt(ru * ru + rv * rv), 9))) AS v FROM points GROUP BY 1) SELECT frame_id, len(v) AS n, round(v[floor(0.9::DOUBLE * (len(v) - 1))::BIGINT + 1], 6) + 0.0 AS quantile FROM l",
    "g6_robust_covariance": _G6,
    "g7_point_spread": f"WITH {_POINTS} SELECT frame_id, count(*) AS n, CASE WHEN count(*) >= 2 THEN round((max(cam_x) - min(cam_x)) * (max(cam_y) - min(cam_y)) / {WIDTH * HEIGHT}, 6) END AS spread FROM points GROUP BY 1",
    "g8_depth_spread": f"WITH {_POINTS} SELECT frame_id, count(*) AS n, round(stddev_pop(sqrt(pow(cam_x - 376, 2) + pow(cam_y - 240, 2) + alt * alt)), 5) AS depth_spread FROM points GROUP BY 1",
    "g9_reprojection": f"WITH {_POINTS} SELECT frame_id, round(avg(sqrt(ru * ru + rv * rv)), 6) AS mean_error FROM points GROUP BY 1",
    "g10_reference_point": f"WITH {_POINTS}, w AS (SELECT *, greatest(score, 0.001) AS w FROM points) SELECT frame_id, round(sum(w * cam_x) / sum(w), 5) AS x, round(sum(w * cam_y) / sum(w), 5) AS y FROM w GROUP BY 1",
    "g13_source_histogram": f"WITH {_RESULTS}, r AS (SELECT nis, {_REASON} AS reason FROM results) SELECT CASE WHEN reason IS NOT NULL THEN 'anchor_rejected_' || reason WHEN nis <= 16.266 THEN 'visual_update' ELSE 'visual_reject_nis' END AS source, count(*) AS n, round(avg(nis), 6) AS mean_nis FROM r GROUP BY 1",
    "g15_summary_averages": f"WITH {_RESULTS} SELECT round(avg(reproj), 6) AS reproj, round(avg(nis), 6) AS nis, round(avg(depth), 6) AS depth, round(avg(var_y), 6) AS var_y FROM results",
    "f2_quality_gate": f"WITH {_RESULTS} SELECT frame_id, {_REASON} AS reason, nis <= 16.266 AS nis_ok FROM results",
    "a26_axis_variances": _A26,
    "a23_nis": _A23,
    "a4_local_enu": _A4,
    "a5_ecef_round_trip": _A5,
    "a10_shift_round_trip": f"WITH {SAMPLES_SQL} SELECT seq, 50.0::DOUBLE AS metres, 5.0::DOUBLE AS climb FROM samples WHERE kind = 'view'",
    "a13_sphere_error": f"WITH {SAMPLES_SQL} SELECT seq, round(radians(lon - 109.1::DOUBLE) * 6378137.0::DOUBLE * cos(radians((lat + 34.1::DOUBLE) / 2)), 6) AS east, round(radians(lat - 34.1::DOUBLE) * 6378137.0::DOUBLE, 6) AS north FROM samples WHERE kind = 'view'",
    "a17_field_of_view": _A17,
    "o3_top_k": f"WITH {_POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, part, line, cam_x) AS rank FROM points) SELECT frame_id, rank, part, score FROM r WHERE rank <= 3",
    "j14_knn_ratio": _J14,
    "j14_mutual": _J14M,
    "j17_bilinear": _J17,
    "j19_box_windows": _J19,
    "o10_stretch": _O10,
}
