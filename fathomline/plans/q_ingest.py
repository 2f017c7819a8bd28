"""Queries of what a run takes in and writes out: ingest rules, gates and scores by row, pair rules, pairwise errors, rows of fixed width."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import geo, vision
from fathomline.operators import asof, clean, evaluate, frames, ingest, sinks
from fathomline.plans.q_composites import SERIES, _lerp
from fathomline.plans.q_frames import _RESULTS, _Z, _POINTS, _trend_sql, points, results
from fathomline.plans.q_tracks import DAY, STATS_SQL, rounded
from fathomline.sources.tables import SAMPLES_SQL, samples

HOLES = "CASE k % 13 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') ELSE alt END"
_HOLES = "CASE WHEN k % 13 IN (0, 1) THEN NULL ELSE alt END"
RISE = 20.0


def s3_valid_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.valid_fixes(samples(spark, sf_dir, "view").withColumn("alt", F.expr(HOLES))).select("vehicle_id", "seq", "t")


def s5_taken_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images 3 to 12 of each vehicle that come while the gate is open."""
    gate = clean.open_gate(samples(spark, sf_dir, "view"), RISE, DAY)
    return ingest.taken_images(samples(spark, sf_dir, "click"), gate.select("vehicle_id", "t", "seq", "is_open"), 3, 12).select("vehicle_id", "seq", "index")


_S5 = f"""WITH {SAMPLES_SQL}, v AS (SELECT *, min(t) OVER (PARTITION BY vehicle_id) AS t0 FROM samples WHERE kind = 'view'),
b AS (SELECT vehicle_id, avg(alt) AS baseline FROM v WHERE t - t0 <= {DAY} + 1e-6 GROUP BY 1),
g AS (SELECT vehicle_id, t, t - t0 > {DAY} + 1e-6 AND alt - baseline > {RISE} AS is_open FROM v JOIN b USING (vehicle_id)),
i AS (SELECT vehicle_id, t, seq, row_number() OVER (PARTITION BY vehicle_id ORDER BY t, seq) AS index FROM samples WHERE kind = 'click' AND t > 0)
SELECT i.vehicle_id, seq, index FROM i ASOF JOIN g ON i.vehicle_id = g.vehicle_id AND i.t >= g.t WHERE is_open AND index BETWEEN 3 AND 12"""


def w7_history_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.trimmed(samples(spark, sf_dir, "view"), 3 * DAY).select("vehicle_id", "seq")


_W7 = f"""WITH {SAMPLES_SQL}, v AS (SELECT vehicle_id, seq, max(t) OVER (PARTITION BY vehicle_id) AS newest, lead(t) OVER (PARTITION BY vehicle_id ORDER BY t, seq) AS after
FROM samples WHERE kind = 'view') SELECT vehicle_id, seq FROM v WHERE after IS NULL OR newest - after <= {3 * DAY}"""


def t3_left_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.left_waiting(samples(spark, sf_dir, "signup"), samples(spark, sf_dir, "view"), samples(spark, sf_dir, "error")).select("vehicle_id", "seq", "failure_reason")


_T3 = f"""WITH {SAMPLES_SQL}, e AS (SELECT vehicle_id, min(t) FILTER (kind = 'view') AS f0, max(t) FILTER (kind = 'view') AS f1, max(t) FILTER (kind = 'error') AS i1 FROM samples GROUP BY 1)
SELECT vehicle_id, seq, CASE WHEN t BETWEEN f0 AND f1 THEN 'waiting_for_future_imu_on_shutdown' ELSE 'waiting_for_future_gps_on_shutdown' END AS failure_reason
FROM samples JOIN e USING (vehicle_id) WHERE kind = 'signup' AND (f1 IS NULL OR t > f1 OR i1 IS NULL OR t > i1)"""


def t17_reference_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ingest.reference_frame(samples(spark, sf_dir, "view").withColumn("alt", F.expr(HOLES))), 9)


_T17 = f"""WITH {SAMPLES_SQL}, f AS (SELECT * FROM samples WHERE kind = 'view' AND {_HOLES} IS NOT NULL AND t > 0)
SELECT vehicle_id, round(t, 9) AS t, round(lon, 9) AS lon, round(lat, 9) AS lat, round(alt, 9) AS alt FROM f QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY t, seq) = 1"""


def t22_replay_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall time runs k milliseconds late."""
    return rounded(ingest.replay_latency(samples(spark, sf_dir, "view"), F.col("t") + F.col("k") / 1000.0).select("vehicle_id", "seq", "replay_ms"), 3)


_T22 = f"""WITH {SAMPLES_SQL}, f AS (SELECT *, first_value(k) OVER (PARTITION BY vehicle_id ORDER BY t, seq) AS k0 FROM samples WHERE kind = 'view')
SELECT vehicle_id, seq, (k - k0)::DOUBLE AS replay_ms FROM f"""


def g16_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.counters(samples(spark, sf_dir), {"fix": "view", "imu": "error", "image": "signup"})


def f4_innovation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate of a measurement; speeds and waits below nought count as nought."""
    gate = vision.innovation_gate(F.lit(30.0), F.lit(0.5), F.col("nis") - 10, F.col("var_x") - 1)
    return rounded(results(spark, sf_dir).select("frame_id", gate.alias("gate")))


def f6_heading_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = vision.heading_failure(F.col("used") >= 50, F.col("nis") < 20, F.col("depth") > 60)
    return results(spark, sf_dir).select("frame_id", reason.alias("reason"))


def g11_safe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(results(spark, sf_dir).select("frame_id", vision.ratio(F.col("nis"), F.col("used") - 20).alias("ratio")))


def a22_crop_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    east, north = geo.rotate_offset(F.col("depth"), F.col("nis"), F.radians(F.col("used") * 1.8))
    return rounded(results(spark, sf_dir).select("frame_id", east.alias("east"), north.alias("north")))


def a24_adapted_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = vision.adapted_scale(F.col("spread"), F.col("nis"), 3.0, 0.25, 0.3, 1.0)
    return rounded(results(spark, sf_dir).select("frame_id", scale.alias("scale")))


def a29_variance_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("frame_id", vision.variance_text(F.col("var_x"), F.col("nis"), F.col("depth")).alias("text"))


def a36_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = vision.condition_2x2(F.col("var_x"), F.col("spread"), F.col("spread"), F.col("relief"))
    return rounded(results(spark, sf_dir).select("frame_id", condition.alias("condition")))


def a37_obliqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle from straight down; the axis comes from columns, one in forty of them nought."""
    x, y, z = F.col("spread") - 0.2, F.col("relief") - 2, 1 - F.col("obliqueness")
    return rounded(results(spark, sf_dir).select("frame_id", vision.obliqueness(x, y, z).alias("degrees")))


def a41_image_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(results(spark, sf_dir).select("frame_id", geo.image_scale(F.col("depth"), F.col("relief"), 400.0, 410.0).alias("scale")))


def a44_heading_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    east, north = vision.heading_weights(F.radians(F.col("used") * 1.8))
    return rounded(results(spark, sf_dir).select("frame_id", east.alias("east"), north.alias("north")))


def f9_scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by frame whose score is 0.4 or more and whose indices lie within their sides."""
    kept = frames.scored(points(spark, sf_dir), "score", 0.4, {"line": 6, "part": 150})
    return kept.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("last"))


def o5_capped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pairs of each frame, as a cap below four is raised to it."""
    return rounded(frames.capped_pairs(points(spark, sf_dir), "score", 2, ["part", "line", "cam_x", "ru", "rv"]).select("frame_id", "rank", "part", "line", "score"))


def o8_first_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.first_frames(results(spark, sf_dir).select("frame_id", "used"), 25, "frame_id")


def o9_best_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three modes of a frame's pairs the one with most of them."""
    modes = points(spark, sf_dir).withColumn("mode", F.col("line") % 3)
    return rounded(frames.best_mode(modes, "mode", "score", ["part", "line", "cam_x", "score"]))


_O9 = f"""WITH {_POINTS}, p AS (SELECT *, line % 3 AS mode, row_number() OVER (PARTITION BY frame_id, line % 3 ORDER BY part, line, cam_x, score) AS r FROM points),
m AS (SELECT frame_id, mode, count(*) AS n, max(score) FILTER (r = 1) AS first_score FROM p GROUP BY 1, 2)
SELECT frame_id, mode, n, round(first_score, 6) AS first_score FROM m QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, first_score DESC, mode) = 1"""


def _pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pairwise_errors({name: samples(spark, sf_dir, kind) for name, kind in SERIES.items()}, samples(spark, sf_dir, "view"))


def e5_pairwise_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of three series, each in its own interval with the reference."""
    return rounded(_pairwise(spark, sf_dir))


def e6_unclipped_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused positions against references that are not clipped."""
    found = evaluate.errors(samples(spark, sf_dir, "purchase"), samples(spark, sf_dir, "view"), False).groupBy("vehicle_id")
    return rounded(found.agg(*evaluate.statistics(F.col("horizontal"))))


def e9_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.magnitudes(_pairwise(spark, sf_dir)))


_E5 = f"""WITH {SAMPLES_SQL}, g AS (SELECT vehicle_id, min(t) AS lo, max(t) AS hi FROM samples WHERE kind = 'view' GROUP BY 1),
n AS (SELECT *, CASE kind WHEN 'click' THEN 'vision' WHEN 'purchase' THEN 'fusion' WHEN 'error' THEN 'imu' END AS series FROM samples),
span AS (SELECT vehicle_id, series, greatest(a.lo, g.lo) AS start, least(a.hi, g.hi) AS stop
  FROM (SELECT vehicle_id, series, min(t) AS lo, max(t) AS hi FROM n WHERE series IS NOT NULL GROUP BY 1, 2) a JOIN g USING (vehicle_id) WHERE greatest(a.lo, g.lo) < least(a.hi, g.hi)),
r AS (SELECT * FROM samples WHERE kind = 'view'), o AS (SELECT n.*, start FROM n JOIN span USING (vehicle_id, series) WHERE t BETWEEN start AND stop),
hi AS (SELECT o.*, r.t AS t1, r.lon AS lon1, r.lat AS lat1, r.alt AS alt1 FROM o ASOF LEFT JOIN r ON o.vehicle_id = r.vehicle_id AND o.t <= r.t),
b AS (SELECT hi.*, r.t AS t0, r.lon AS lon0, r.lat AS lat0, r.alt AS alt0 FROM hi ASOF LEFT JOIN r ON hi.vehicle_id = r.vehicle_id AND hi.t > r.t),
m AS (SELECT *, {_lerp("lon")}, {_lerp("lat")}, {_lerp("alt")} FROM b WHERE t1 IS NOT NULL AND (t0 IS NOT NULL OR abs(t1 - t) <= 1e-9)),
d AS (SELECT *, t - start AS since, radians(lon - rlon) * 6378137.0::DOUBLE * cos(radians((lat + rlat) / 2)) AS east, radians(lat - rlat) * 6378137.0::DOUBLE AS north, alt - ralt AS up FROM m),
e AS (SELECT *, sqrt(east * east + north * north + up * up) AS spatial, sqrt(east * east + north * north) AS horizontal FROM d)"""


def k1_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as lines of nine decimals, missing numbers as nan."""
    s = samples(spark, sf_dir, "view").select("seq", "t", "lon", "lat", F.when(F.col("k") % 2 == 0, F.col("alt")).alias("alt"))
    return sinks.csv_lines(s, dict.fromkeys(["t", "lon", "lat", "alt"], 9))


def k2_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result row of each frame, to five decimals; variances of altitude above 10,000 are cut there."""
    values = {c: F.col(c) for c in ("reproj", "spread", "depth", "obliqueness", "relief")}
    values |= {"pnp_rate": F.col("inlier_ratio"), "homography_rate": F.col("inlier_ratio"), "h_rmse": F.col("var_x"), "inliers": F.col("used").cast("double")}
    x, y, z = vision.axis_variances(values, F.col("var_x"), F.col("var_y"))
    key = F.col("frame_id")
    given = results(spark, sf_dir).select("*", x.alias("x"), y.alias("y"), F.when(z.isNotNull(), F.least(z, F.lit(1e4))).alias("z")).withColumns(
        {
            "image_index": key, "image_stamp_sec": key / 4, "map_feature_points": F.col("used") + 5, "localization_used_points": F.col("used"), "localization_inlier_points": F.col("used"),
            "pnp_inlier_rate": F.col("inlier_ratio"), "reproj_error": F.col("reproj"), "terrain_relief_m": F.col("relief"), "point_spread_img_ratio": F.col("spread"),
            "obliqueness_deg": F.col("obliqueness"), "dual_geom_valid": F.col("var_y").isNotNull(), "dual_geom_var_x_m2": F.col("var_x"), "dual_geom_var_y_m2": F.col("var_y"),
            "yaw_compass_deg": F.when(key % 5 != 0, key % 360), "localization_success": F.col("reproj") < 6, "failure_reason": F.when(F.col("reproj") >= 6, 'error, "large"'),
        }
    )
    return sinks.result_lines(given, F.col("x"), F.col("y"), F.col("z"), digits=5)


def _num(x: str, digits: int = 5, missing: str = "nan") -> str:
    return f"CASE WHEN {x} IS NULL THEN '{missing}' ELSE printf('%.{digits}f', {x}) END"


_K2_VALUES = {
    "image_index": "frame_id::VARCHAR", "image_stamp_sec": _num("frame_id / 4.0::DOUBLE"), "map_feature_points": "(used + 5)::VARCHAR", "localization_used_points": "used::VARCHAR",
    "localization_inlier_points": "used::VARCHAR", "pnp_inlier_rate": _num("inlier_ratio"), "reproj_error": _num("reproj"), "terrain_relief_m": _num("relief"),
    "point_spread_img_ratio": _num("spread"), "obliqueness_deg": _num("obliqueness"), "dual_geom_valid": "CASE WHEN var_y IS NULL THEN '0' ELSE '1' END", "dual_geom_var_x_m2": _num("var_x"),
    "dual_geom_var_y_m2": _num("var_y"), "pred_x_sigma_m": _num("sqrt(x)"), "pred_y_sigma_m": _num("sqrt(y)"), "pred_z_sigma_m": _num("sqrt(z)"),
    "pred_var_diag_m2": f"'\"[' || {_num('x')} || ',' || {_num('y')} || ',' || {_num('z')} || ']\"'", "yaw_compass_deg": _num("yaw"), "heading_east_weight": _num("pow(sin(radians(yaw)), 2)"),
    "heading_north_weight": _num("pow(cos(radians(yaw)), 2)"), "localization_success": "CASE WHEN reproj < 6 THEN '1' ELSE '0' END",
    "failure_reason": "CASE WHEN reproj >= 6 THEN '\"error, \"\"large\"\"\"' ELSE '' END",
}
_K2_ZERO = ("aerial_feature_points", "lightglue_match_pairs", "homography_used_pairs", "homography_inlier_count", "pnp_input_points")
_K2 = f"""WITH {_RESULTS}, p AS (SELECT *, var_x * {_trend_sql(vision.X_TREND, vision.X_CLIP)} AS x, var_y * {_trend_sql(vision.Y_TREND, vision.Y_CLIP)} AS y,
  CASE WHEN {_Z} IS NOT NULL THEN least({_Z}, 1e4::DOUBLE) END AS z, CASE WHEN frame_id % 5 <> 0 THEN (frame_id % 360)::DOUBLE END AS yaw FROM results)
SELECT frame_id AS image_index, {" || ',' || ".join(_K2_VALUES.get(c, "'0'" if c in _K2_ZERO else _num("depth") if c == "depth" else "'nan'") for c in sinks.RESULT_COLUMNS)} AS line FROM p"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes with the last fused position of a day and the last anchor before them."""
    fixes = samples(spark, sf_dir, "view").select("vehicle_id", "t", "seq", "lon", "lat", "alt", "k")
    fused = asof.latest(fixes, samples(spark, sf_dir, "purchase"), ["lon", "lat", "alt"], DAY, prefix="p_")
    met = asof.latest(fused, samples(spark, sf_dir, "click").withColumn("image", F.col("seq")), ["lon", "lat", "alt", "image"], prefix="a_")
    ok = F.col("p_t").isNotNull()
    return met.select(
        F.col("seq").alias("fix_index"), F.col("t").alias("fix_stamp_sec"), F.col("lon").alias("gt_lon"), F.col("lat").alias("gt_lat"), F.col("alt").alias("gt_alt"), ok.alias("pred_available"),
        F.col("p_lon").alias("pred_lon"), F.col("p_lat").alias("pred_lat"), F.col("p_alt").alias("pred_alt"), F.col("a_image").alias("visual_anchor_image_index"),
        F.col("a_t").alias("visual_anchor_stamp_sec"), F.col("a_lon").alias("visual_anchor_lon"), F.col("a_lat").alias("visual_anchor_lat"), F.col("a_alt").alias("visual_anchor_alt"),
        (F.col("k") * 3.5).alias("heading_used_deg"), F.when(ok, F.col("t") - F.col("p_t")).alias("propagate_dt_sec"), vision.anchor_age(F.col("t"), F.col("a_t")).alias("age"),
        (F.col("k") % 3).alias("anchor_reject_count"), F.when(F.col("k") % 3 == 1, 'too "far"').alias("anchor_reject_reason"), F.lit("imu").alias("heading_source"),
        F.when(~ok, "fused_position_invalid").alias("failure_reason"),
    ).withColumn("visual_anchor_age_sec", F.when(F.col("visual_anchor_stamp_sec").isNotNull(), F.col("age")))


def k3_fusion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.fusion_lines(_fused(spark, sf_dir))


def k9_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as the topic has them."""
    return sinks.fusion_json(_fused(spark, sf_dir))


def _fused_sql(missing: str, flag: tuple[str, str], far: str, quote: str) -> dict[str, str]:
    n = lambda x: _num(x, 9, missing)
    text = lambda x: f"{quote} || {x} || {quote}" if quote else x
    return {
        "fix_index": "seq::VARCHAR", "fix_stamp_sec": n("t"), "gt_lon": n("lon"), "gt_lat": n("lat"), "gt_alt": n("alt"), "pred_available": f"CASE WHEN tp IS NULL THEN '{flag[0]}' ELSE '{flag[1]}' END",
        "pred_lon": n("lonp"), "pred_lat": n("latp"), "pred_alt": n("altp"), "visual_anchor_image_index": "coalesce(seqa, 0)::VARCHAR", "visual_anchor_stamp_sec": n("ta"),
        "visual_anchor_lon": n("lona"), "visual_anchor_lat": n("lata"), "visual_anchor_alt": n("alta"), "heading_used_deg": n("k * 3.5::DOUBLE"), "propagate_dt_sec": n("t - tp"),
        "visual_anchor_age_sec": n("t - ta"), "anchor_reject_count": "(k % 3)::VARCHAR", "anchor_reject_reason": f"CASE WHEN k % 3 = 1 THEN {far} ELSE {text(chr(39) * 2)} END",
        "heading_source": text("'imu'"), "failure_reason": text("CASE WHEN tp IS NULL THEN 'fused_position_invalid' ELSE '' END"),
    }


_FUSED = f"""WITH {SAMPLES_SQL}, f AS (SELECT * FROM samples WHERE kind = 'view'), p AS (SELECT * FROM samples WHERE kind = 'purchase'), c AS (SELECT * FROM samples WHERE kind = 'click'),
g AS (SELECT f.*, p.t AS q, p.lon AS ql, p.lat AS qa, p.alt AS qh FROM f ASOF LEFT JOIN p ON f.vehicle_id = p.vehicle_id AND f.t >= p.t),
h AS (SELECT *, CASE WHEN t - q <= {DAY} THEN q END AS tp, CASE WHEN t - q <= {DAY} THEN ql END AS lonp, CASE WHEN t - q <= {DAY} THEN qa END AS latp, CASE WHEN t - q <= {DAY} THEN qh END AS altp FROM g),
u AS (SELECT h.*, c.t AS ta, c.lon AS lona, c.lat AS lata, c.alt AS alta, c.seq AS seqa FROM h ASOF LEFT JOIN c ON h.vehicle_id = c.vehicle_id AND h.t >= c.t)"""
_CSV = _fused_sql("", ("0", "1"), "'\"too \"\"far\"\"\"'", "")
_JSON = _fused_sql("null", ("false", "true"), "'\"too \\\"far\\\"\"'", "'\"'")
_K3 = f"{_FUSED} SELECT seq AS fix_index, " + " || ',' || ".join(_CSV.get(c, "''") for c in sinks.FUSION_COLUMNS) + " AS line FROM u"
_K9 = f"{_FUSED} SELECT seq AS fix_index, '{{' || " + " || ',' || ".join(f"'\"{c}\":' || " + _JSON.get(c, "'null'") for c in sinks.FUSION_COLUMNS) + " || '}' AS json FROM u"

_FRAMES = f"WITH {_RESULTS} SELECT frame_id, "
_AXIS = "(spread - 0.2::DOUBLE)", "(relief - 2)", "(1 - obliqueness)"
_LENGTH = f"sqrt({' + '.join(f'{a} * {a}' for a in _AXIS)})"
_TRACE = "(var_x * var_x + spread * spread + spread * spread + relief * relief)"
_DET = "(var_x * relief - spread * spread)"
_ROOT = f"sqrt(greatest(0.0::DOUBLE, {_TRACE} * {_TRACE} / 4 - {_DET} * {_DET}))"

QUERIES = {
    f.__name__: f
    for f in (
        s3_valid_fixes, s5_taken_images, w7_history_trim, t3_left_waiting, t17_reference_frame, t22_replay_latency, g16_counters, f4_innovation_gate, f6_heading_failure, g11_safe_ratio,
        a22_crop_offset, a24_adapted_scale, a29_variance_text, a36_condition, a37_obliqueness, a41_image_scale, a44_heading_weights, f9_scored_pairs, o5_capped_pairs, o8_first_frames,
        o9_best_mode, e5_pairwise_errors, e6_unclipped_stats, e9_magnitudes, k1_csv_rows, k2_result_rows, k3_fusion_rows, k9_json_rows,
    )
}
ORACLES = {
    "s3_valid_fixes": f"WITH {SAMPLES_SQL} SELECT vehicle_id, seq, t FROM samples WHERE kind = 'view' AND {_HOLES} IS NOT NULL AND t > 0",
    "s5_taken_images": _S5,
    "w7_history_trim": _W7,
    "t3_left_waiting": _T3,
    "t17_reference_frame": _T17,
    "t22_replay_latency": _T22,
    "g16_counters": "SELECT count(*) FILTER (event_type = 'view') AS fix_count, count(*) FILTER (event_type = 'error') AS imu_count, count(*) FILTER (event_type = 'signup') AS image_count FROM events",
    "f4_innovation_gate": f"{_FRAMES} round(30 + 0.5::DOUBLE * greatest(0.0::DOUBLE, nis - 10) * greatest(0.0::DOUBLE, var_x - 1), 6) AS gate FROM results",
    "f6_heading_failure": f"""{_FRAMES} CASE WHEN used < 50 THEN 'heading_unavailable' WHEN nis < 20 AND depth > 60 THEN 'low_speed_and_high_residual' WHEN nis < 20 THEN 'low_speed'
  WHEN depth > 60 THEN 'high_residual' ELSE 'heading_invalid' END AS reason FROM results""",
    "g11_safe_ratio": f"{_FRAMES} CASE WHEN used > 20 THEN round(nis / (used - 20), 6) END AS ratio FROM results",
    "a22_crop_offset": f"{_FRAMES} round(depth * sin(h) + nis * cos(h), 6) + 0.0 AS east, round(depth * cos(h) - nis * sin(h), 6) + 0.0 AS north FROM (SELECT *, radians(used * 1.8::DOUBLE) AS h FROM results)",
    "a24_adapted_scale": f"{_FRAMES} round(greatest(0.3::DOUBLE, least(1.0::DOUBLE, spread * pow(greatest(0.25::DOUBLE, least(4.0::DOUBLE, nis / 3.0::DOUBLE)), 0.25::DOUBLE))), 6) AS scale FROM results",
    "a29_variance_text": f"{_FRAMES} '[' || printf('%.9f', var_x) || ',' || printf('%.9f', nis) || ',' || printf('%.9f', depth) || ']' AS text FROM results",
    "a36_condition": f"{_FRAMES} CASE WHEN abs({_DET}) >= 1e-12 THEN round(sqrt(({_TRACE} / 2 + {_ROOT}) / nullif({_TRACE} / 2 - {_ROOT}, 0)), 6) END AS condition FROM results",
    "a37_obliqueness": f"{_FRAMES} CASE WHEN {_LENGTH} > 1e-12 THEN round(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, -{_AXIS[2]} / {_LENGTH})))), 6) + 0.0 END AS degrees FROM results",
    "a41_image_scale": f"{_FRAMES} round(abs(depth - relief) / sqrt(400.0::DOUBLE * 410.0::DOUBLE), 6) AS scale FROM results",
    "a44_heading_weights": f"{_FRAMES} round(pow(sin(radians(used * 1.8::DOUBLE)), 2), 6) AS east, round(pow(cos(radians(used * 1.8::DOUBLE)), 2), 6) AS north FROM results",
    "f9_scored_pairs": f"WITH {_POINTS} SELECT frame_id, count(*) AS n, max(part) AS last FROM points WHERE score >= 0.4::DOUBLE AND line BETWEEN 0 AND 5 AND part BETWEEN 0 AND 149 GROUP BY 1",
    "o5_capped_pairs": f"""WITH {_POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, part, line, cam_x, ru, rv)::INT AS rank FROM points)
SELECT frame_id, rank, part, line, round(score, 6) AS score FROM r WHERE rank <= 4""",
    "o8_first_frames": f"{_FRAMES} used FROM results ORDER BY frame_id LIMIT 25",
    "o9_best_mode": _O9,
    "e5_pairwise_errors": f"{_E5} SELECT vehicle_id, seq, series, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('since', 'east', 'north', 'up', 'spatial'))} FROM e",
    "e6_unclipped_stats": f"{_E5} SELECT vehicle_id, {STATS_SQL.format(x='horizontal')} FROM e WHERE series = 'fusion' GROUP BY 1",
    "e9_magnitudes": f"""{_E5} SELECT series, count(*) AS n, {', '.join(f'round(avg(abs({c})), 6) AS mean_abs_{c}' for c in ('east', 'north', 'up'))}, round(avg(spatial), 6) AS mean_total FROM e GROUP BY 1""",
    "k1_csv_rows": f"WITH {SAMPLES_SQL} SELECT seq || ',' || printf('%.9f', t) || ',' || printf('%.9f', lon) || ',' || printf('%.9f', lat) || ',' || CASE WHEN k % 2 = 0 THEN printf('%.9f', alt) ELSE 'nan' END AS line FROM samples WHERE kind = 'view'",
    "k2_result_rows": _K2,
    "k3_fusion_rows": _K3,
    "k9_json_rows": _K9,
}
