"""Queries over tracks: as-of joins, evaluation, heading, cleaning, gates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.angles import compass_of, lerp_angle
from fathomline.functions.decimals import rounded_to
from fathomline.operators import asof, clean, evaluate, heading
from fathomline.sources.tables import SAMPLES_SQL, samples

DAY, HOUR = 86400.0, 3600.0
THRESHOLDS = [10.0, 30.0, 50.0, 80.0, 100.0]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0."""
    return df.select(*[(rounded_to(F.col(c), digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.errors(samples(spark, sf_dir, "click"), samples(spark, sf_dir, "view"))


#: Errors of clicks against views, as evaluate.errors has them.
ERRORS_SQL = f"""
{SAMPLES_SQL},
ref AS (SELECT * FROM samples WHERE kind = 'view'),
own AS (SELECT * FROM samples WHERE kind = 'click'),
span AS (
  SELECT vehicle_id, greatest(a.lo, b.lo) AS start, least(a.hi, b.hi) AS stop
  FROM (SELECT vehicle_id, min(t) AS lo, max(t) AS hi FROM own GROUP BY 1) a
  JOIN (SELECT vehicle_id, min(t) AS lo, max(t) AS hi FROM ref GROUP BY 1) b USING (vehicle_id)
  WHERE greatest(a.lo, b.lo) < least(a.hi, b.hi)
),
o AS (SELECT own.*, start, stop FROM own JOIN span USING (vehicle_id) WHERE t BETWEEN start AND stop),
r AS (SELECT ref.* FROM ref JOIN span USING (vehicle_id) WHERE t BETWEEN start AND stop),
hi AS (SELECT o.*, r.t AS t1, r.lon AS lon1, r.lat AS lat1, r.alt AS alt1 FROM o ASOF JOIN r ON o.vehicle_id = r.vehicle_id AND o.t <= r.t),
both_ends AS (SELECT hi.*, r.t AS t0, r.lon AS lon0, r.lat AS lat0, r.alt AS alt0 FROM hi ASOF LEFT JOIN r ON hi.vehicle_id = r.vehicle_id AND hi.t > r.t),
met AS (
  SELECT vehicle_id, t, seq, start, lon, lat, alt,
    CASE WHEN abs(t1 - t) <= 1e-9 THEN lon1 ELSE lon0 + (t - t0) / (t1 - t0) * (lon1 - lon0) END AS ref_lon,
    CASE WHEN abs(t1 - t) <= 1e-9 THEN lat1 ELSE lat0 + (t - t0) / (t1 - t0) * (lat1 - lat0) END AS ref_lat,
    CASE WHEN abs(t1 - t) <= 1e-9 THEN alt1 ELSE alt0 + (t - t0) / (t1 - t0) * (alt1 - alt0) END AS ref_alt
  FROM both_ends WHERE t0 IS NOT NULL OR abs(t1 - t) <= 1e-9
),
parts AS (
  SELECT *, t - start AS since, radians(lon - ref_lon) * 6378137.0::DOUBLE * cos(radians((lat + ref_lat) / 2)) AS east,
         radians(lat - ref_lat) * 6378137.0::DOUBLE AS north, alt - ref_alt AS up FROM met
),
errors AS (SELECT *, sqrt(east * east + north * north) AS horizontal, sqrt(east * east + north * north + up * up) AS spatial FROM parts)"""

STATS_SQL = "count({x}) AS n, round(avg({x}), 6) AS mean, round(sqrt(avg({x} * {x})), 6) AS rmse, round(max(abs({x})), 6) AS max_abs"


def traj_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vehicle: error statistics and the shares below each threshold."""
    e = _errors(spark, sf_dir)
    shares = [(F.count_if(F.col("horizontal") < v) * 100.0 / F.count("horizontal")).alias(f"below_{int(v)}") for v in THRESHOLDS]
    return rounded(e.groupBy("vehicle_id").agg(*evaluate.statistics(F.col("horizontal")), *shares))


_shares = ", ".join(f"round(count(*) FILTER (horizontal < {v}) * 100.0 / count(*), 6) AS below_{int(v)}" for v in THRESHOLDS)


def _point(df: DataFrame) -> DataFrame:
    return rounded(df.select("vehicle_id", "seq", "ref_lon", "ref_lat", "ref_alt"), 9)


def j1_asof_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _point(asof.interpolate(samples(spark, sf_dir, "click"), samples(spark, sf_dir, "view"), ["lon", "lat", "alt"], "closed"))


def j3_asof_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _point(asof.interpolate(samples(spark, sf_dir, "click"), samples(spark, sf_dir, "view"), ["lon", "lat", "alt"], "inner"))


def j5_asof_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _point(asof.interpolate(samples(spark, sf_dir, "click"), samples(spark, sf_dir, "view"), ["lon", "lat", "alt"], "clamped"))


def _asof_sql(where: str, clamped: bool = False) -> str:
    one = lambda f: (
        f"CASE WHEN abs(t1 - t) <= 1e-9 THEN {f}1 WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN {f}0 + (t - t0) / (t1 - t0) * ({f}1 - {f}0)"
        + (f" WHEN t1 IS NULL THEN {f}0 ELSE {f}1" if clamped else "")
        + " END"
    )
    return f"""WITH {SAMPLES_SQL}, r AS (SELECT * FROM samples WHERE kind = 'view'), o AS (SELECT * FROM samples WHERE kind = 'click'),
hi AS (SELECT o.*, r.t AS t1, r.lon AS lon1, r.lat AS lat1, r.alt AS alt1 FROM o ASOF LEFT JOIN r ON o.vehicle_id = r.vehicle_id AND o.t <= r.t),
b AS (SELECT hi.*, r.t AS t0, r.lon AS lon0, r.lat AS lat0, r.alt AS alt0 FROM hi ASOF LEFT JOIN r ON hi.vehicle_id = r.vehicle_id AND hi.t > r.t)
SELECT vehicle_id, seq, {", ".join(f"round({one(f)}, 9) AS ref_{f}" for f in ("lon", "lat", "alt"))} FROM b {where}"""


def j6_heading_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles between neighbours along the shorter arc, clamped at the ends."""
    refs = samples(spark, sf_dir, "view").withColumn("psi", F.col("k") * 0.0628)
    out = asof.interpolate(samples(spark, sf_dir, "click"), refs, ["psi"], "clamped", lerp={"psi": lerp_angle})
    return rounded(out.select("vehicle_id", "seq", compass_of(F.col("ref_psi")).alias("compass")))


_PI = "3.141592653589793::DOUBLE"
_J6 = f"""WITH {SAMPLES_SQL}, r AS (SELECT vehicle_id, t, k * 0.0628::DOUBLE AS psi FROM samples WHERE kind = 'view'), o AS (SELECT * FROM samples WHERE kind = 'click'),
hi AS (SELECT o.*, r.t AS t1, r.psi AS p1 FROM o ASOF LEFT JOIN r ON o.vehicle_id = r.vehicle_id AND o.t <= r.t),
b AS (SELECT hi.*, r.t AS t0, r.psi AS p0 FROM hi ASOF LEFT JOIN r ON hi.vehicle_id = r.vehicle_id AND hi.t > r.t),
d AS (SELECT *, fmod(p1 - p0 + {_PI}, 2 * {_PI}) AS m FROM b),
w AS (SELECT *, CASE WHEN m <= 0 THEN m + 2 * {_PI} ELSE m END - {_PI} AS turn FROM d),
a AS (SELECT vehicle_id, seq, CASE WHEN abs(t1 - t) <= 1e-9 THEN p1 WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN p0 + (t - t0) / (t1 - t0) * turn
      WHEN t1 IS NULL THEN p0 ELSE p1 END AS psi FROM w)
SELECT vehicle_id, seq, round(fmod(fmod({_PI} / 2 - psi, 2 * {_PI}) + 2 * {_PI}, 2 * {_PI}), 6) AS compass FROM a"""


def j8_asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last reference at or before each sample, half a day old at most."""
    out = asof.latest(samples(spark, sf_dir, "click"), samples(spark, sf_dir, "view"), ["lon", "alt"], tolerance=DAY / 2)
    return rounded(out.select("vehicle_id", "seq", "ref_t", "ref_lon", "ref_alt"), 9)


_J8 = f"""WITH {SAMPLES_SQL}, r AS (SELECT * FROM samples WHERE kind = 'view'), o AS (SELECT * FROM samples WHERE kind = 'click')
SELECT o.vehicle_id, o.seq, round(CASE WHEN o.t - r.t <= 43200 THEN r.t END, 9) AS ref_t, round(CASE WHEN o.t - r.t <= 43200 THEN r.lon END, 9) AS ref_lon,
       round(CASE WHEN o.t - r.t <= 43200 THEN r.alt END, 9) AS ref_alt
FROM o ASOF LEFT JOIN r ON o.vehicle_id = r.vehicle_id AND o.t >= r.t"""


def j11_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with fix, inertial and heading neighbours, and why a frame can't be prepared."""
    frames = samples(spark, sf_dir, "signup").select("vehicle_id", "t", "seq")
    fix = samples(spark, sf_dir, "view")
    imu = samples(spark, sf_dir, "error")
    a = asof.neighbours(frames, fix, ["lat"]).withColumnsRenamed({"before": "fix_before", "after": "fix_after"})
    b = asof.neighbours(a, imu, ["k"])
    reason = (
        F.when(F.col("fix_after").isNull(), "waiting_for_future_gps")
        .when(F.col("after").isNull(), "waiting_for_future_imu")
        .when(F.col("fix_before").isNull() & (F.col("fix_after.t") > F.col("t")), "before_first_fix")
        .when(F.col("before").isNull() & (F.col("after.t") > F.col("t")), "before_first_imu")
        .otherwise("ready")
    )
    return b.select("vehicle_id", "seq", reason.alias("reason"))


_J11 = f"""WITH {SAMPLES_SQL},
fix AS (SELECT vehicle_id, min(t) AS lo, max(t) AS hi FROM samples WHERE kind = 'view' GROUP BY 1),
imu AS (SELECT vehicle_id, min(t) AS lo, max(t) AS hi FROM samples WHERE kind = 'error' GROUP BY 1)
SELECT s.vehicle_id, s.seq, CASE WHEN fix.hi IS NULL OR s.t > fix.hi THEN 'waiting_for_future_gps' WHEN imu.hi IS NULL OR s.t > imu.hi THEN 'waiting_for_future_imu'
  WHEN s.t < fix.lo THEN 'before_first_fix' WHEN s.t < imu.lo THEN 'before_first_imu' ELSE 'ready' END AS reason
FROM samples s LEFT JOIN fix USING (vehicle_id) LEFT JOIN imu USING (vehicle_id) WHERE s.kind = 'signup'"""


def g17_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j11_sync(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def g1_error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every component over all vehicles."""
    e = _errors(spark, sf_dir)
    long = e.select(F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("x")) for c in ("east", "north", "up", "horizontal", "spatial")])).alias("c")).select("c.*")
    return rounded(long.groupBy("component").agg(*evaluate.statistics(F.col("x"))))


_G1 = f"WITH {ERRORS_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS component, {STATS_SQL.format(x=c)} FROM errors" for c in ("east", "north", "up", "horizontal", "spatial"))


def g2_threshold_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.below_thresholds(_errors(spark, sf_dir), "horizontal", THRESHOLDS))


_G2 = f"""WITH {ERRORS_SQL} SELECT count(horizontal) AS n, threshold, count(*) FILTER (horizontal < threshold) AS below,
round(100.0 * count(*) FILTER (horizontal < threshold) / count(horizontal), 6) AS percent
FROM errors, (SELECT unnest([{", ".join(map(str, THRESHOLDS))}])::DOUBLE AS threshold) GROUP BY threshold"""


def g21_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where three series overlap."""
    return rounded(evaluate.overlap(*[samples(spark, sf_dir, k) for k in ("view", "click", "purchase")]))


_G21 = f"""WITH {SAMPLES_SQL}, e AS (SELECT vehicle_id, kind, min(t) AS lo, max(t) AS hi FROM samples WHERE kind IN ('view', 'click', 'purchase') GROUP BY ALL)
SELECT vehicle_id, round(max(lo), 6) AS start, round(min(hi), 6) AS stop FROM e GROUP BY 1 HAVING count(*) = 3 AND max(lo) < min(hi)"""


def g12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors less the mean error of the first five days, as statistics per vehicle."""
    e = _errors(spark, sf_dir)
    late = evaluate.aligned(e, evaluate.alignment(e, 5 * DAY), 5 * DAY)
    return rounded(late.groupBy("vehicle_id").agg(*evaluate.statistics(F.col("horizontal"))))


_G12 = f"""WITH {ERRORS_SQL}, f AS (SELECT vehicle_id, avg(east) AS e0, avg(north) AS n0 FROM errors WHERE since >= 0 AND since < 432000 GROUP BY 1),
late AS (SELECT vehicle_id, sqrt((east - e0) * (east - e0) + (north - n0) * (north - n0)) AS h FROM errors JOIN f USING (vehicle_id) WHERE since >= 432000)
SELECT vehicle_id, {STATS_SQL.format(x="h")} FROM late GROUP BY 1"""


def w1_sliding_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = heading.velocity(samples(spark, sf_dir, "view"), 15)
    return out.select("vehicle_id", "seq", "n", *[(rounded_to(F.col(c), 5) + 0.0).alias(c) for c in ("v_east", "v_north")], (rounded_to(F.col("rms"), 2) + 0.0).alias("rms"))


#: The window as the reference text has it: metres of every point from the window's first point.
_FIT = f"""{SAMPLES_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t, seq) AS i FROM samples WHERE kind = 'view'),
p AS (SELECT a.vehicle_id, a.seq, a.t, a.i, b.t AS bt, b.lat AS blat, b.lon AS blon,
        first_value(b.lat) OVER w AS lat0, first_value(b.lon) OVER w AS lon0, first_value(b.t) OVER w AS t0
      FROM v a JOIN v b ON a.vehicle_id = b.vehicle_id AND b.i BETWEEN a.i - 14 AND a.i WINDOW w AS (PARTITION BY a.vehicle_id, a.i ORDER BY b.i)),
m AS (SELECT *, bt - t0 AS x, 1 - 6.69437999014e-3::DOUBLE * pow(sin(radians(lat0)), 2) AS w2 FROM p),
e AS (SELECT *, radians(blon - lon0) * 6378137.0::DOUBLE / sqrt(w2) * cos(radians(lat0)) AS ea,
        radians(blat - lat0) * 6378137.0::DOUBLE * (1 - 6.69437999014e-3::DOUBLE) / (w2 * sqrt(w2)) AS no FROM m),
s AS (SELECT vehicle_id, seq, t, i, count(*) AS n, regr_sxx(ea, x) AS tt, regr_sxy(ea, x) AS te, regr_syy(ea, x) AS ee, regr_sxy(no, x) AS tn, regr_syy(no, x) AS nn FROM e GROUP BY ALL),
fit AS (SELECT vehicle_id, seq, t, n, CASE WHEN n >= 3 AND tt > 0 THEN te / tt END AS v_east, CASE WHEN n >= 3 AND tt > 0 THEN tn / tt END AS v_north,
          CASE WHEN n >= 3 AND tt > 0 THEN sqrt(greatest(0, ee - te / tt * te + nn - tn / tt * tn) / n) END AS rms FROM s)"""
_W1 = f"WITH {_FIT} SELECT vehicle_id, seq, n, round(v_east, 5) + 0.0 AS v_east, round(v_north, 5) + 0.0 AS v_north, round(rms, 2) + 0.0 AS rms FROM fit"
MIN_SPEED, MAX_RMS = 0.01, 60.0


def w3_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = heading.headings(samples(spark, sf_dir, "view"), 15, MIN_SPEED, MAX_RMS)
    return out.select("vehicle_id", "seq", "valid", (rounded_to(F.col("heading"), 4) + 0.0).alias("heading"))


_W3 = f"""WITH {_FIT}, g AS (SELECT *, coalesce(sqrt(v_east * v_east + v_north * v_north) >= {MIN_SPEED} AND rms <= {MAX_RMS}, false) AS valid, atan2(v_north, v_east) AS psi FROM fit),
h AS (SELECT *, last_value(CASE WHEN valid THEN psi END IGNORE NULLS) OVER (PARTITION BY vehicle_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS kept FROM g)
SELECT vehicle_id, seq, valid, round(fmod(fmod({_PI} / 2 - coalesce(kept, psi, 0), 2 * {_PI}) + 2 * {_PI}, 2 * {_PI}), 4) + 0.0 AS heading FROM h"""
JUMP = 500.0
_DIST = "sqrt(pow(radians(v.lon - c.lon) * 6378137.0::DOUBLE * cos(radians((v.lat + c.lat) / 2)), 2) + pow(radians(v.lat - c.lat) * 6378137.0::DOUBLE, 2))"
_JUMPS = f"""{SAMPLES_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t, seq) AS i FROM samples WHERE kind = 'view'),
c AS (SELECT vehicle_id, seq, t, alt, i, lon, lat, lon AS own_lon, lat AS own_lat, true AS accepted FROM v WHERE i = 1
      UNION ALL SELECT v.vehicle_id, v.seq, v.t, v.alt, v.i, CASE WHEN {_DIST} <= {JUMP} THEN v.lon ELSE c.lon END, CASE WHEN {_DIST} <= {JUMP} THEN v.lat ELSE c.lat END, v.lon, v.lat, {_DIST} <= {JUMP}
      FROM c JOIN v ON v.vehicle_id = c.vehicle_id AND v.i = c.i + 1)"""


def w5_jump_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.mark_jumps(samples(spark, sf_dir, "view"), JUMP).select("vehicle_id", "seq", "accepted")


def w6_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = clean.fill_rejected(clean.mark_jumps(samples(spark, sf_dir, "view"), JUMP))
    return rounded(filled.select("vehicle_id", "seq", "lon", "lat", "alt"), 9)


_W6 = f"""WITH RECURSIVE {_JUMPS}, n AS (
  SELECT vehicle_id, seq, t, accepted, own_lon AS lon, own_lat AS lat, alt,
    last_value(CASE WHEN accepted THEN struct_pack(t := t, lon := own_lon, lat := own_lat, alt := alt) END IGNORE NULLS) OVER (PARTITION BY vehicle_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS a,
    first_value(CASE WHEN accepted THEN struct_pack(t := t, lon := own_lon, lat := own_lat, alt := alt) END IGNORE NULLS) OVER (PARTITION BY vehicle_id ORDER BY t, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
  FROM c)
SELECT vehicle_id, seq, {", ".join(f"round(CASE WHEN accepted THEN {f} ELSE coalesce(a.{f} + CASE WHEN b.t > a.t THEN (t - a.t) / (b.t - a.t) ELSE 0 END * (b.{f} - a.{f}), a.{f}, b.{f}) END, 9) AS {f}" for f in ("lon", "lat", "alt"))} FROM n"""


def a9_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.throttle(samples(spark, sf_dir), HOUR).select("vehicle_id", "seq")


_A9 = f"""WITH RECURSIVE {SAMPLES_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t, seq) AS i FROM samples),
c AS (SELECT vehicle_id, seq, i, t AS last, true AS out FROM v WHERE i = 1
      UNION ALL SELECT v.vehicle_id, v.seq, v.i, CASE WHEN v.t - c.last + 1e-9 >= 3600 THEN v.t ELSE c.last END, v.t - c.last + 1e-9 >= 3600 FROM c JOIN v ON v.vehicle_id = c.vehicle_id AND v.i = c.i + 1)
SELECT vehicle_id, seq FROM c WHERE out"""


def f7_open_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean.open_gate(samples(spark, sf_dir, "view"), rise=20.0, seconds=5 * DAY)
    return rounded(out.select("vehicle_id", "seq", "baseline", "is_open", "edge"))


_F7 = f"""WITH {SAMPLES_SQL}, v AS (SELECT *, t - min(t) OVER (PARTITION BY vehicle_id) <= 432000 + 1e-6 AS early FROM samples WHERE kind = 'view'),
b AS (SELECT *, avg(CASE WHEN early THEN alt END) OVER (PARTITION BY vehicle_id) AS baseline FROM v),
o AS (SELECT *, NOT early AND alt - baseline > 20 AS is_open FROM b),
l AS (SELECT *, coalesce(lag(is_open) OVER (PARTITION BY vehicle_id ORDER BY t, seq), false) AS was FROM o)
SELECT vehicle_id, seq, round(baseline, 6) AS baseline, is_open, CASE WHEN is_open AND NOT was THEN 'open' WHEN NOT is_open AND was THEN 'close' END AS edge FROM l"""


def t6_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.sessions(samples(spark, sf_dir), 12 * HOUR))


_T6 = f"""WITH {SAMPLES_SQL}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY vehicle_id ORDER BY t, seq) > 43200 THEN 1 ELSE 0 END AS new FROM samples),
s AS (SELECT *, sum(new) OVER (PARTITION BY vehicle_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
SELECT vehicle_id, session, round(min(t), 6) AS start, round(max(t), 6) AS stop, count(*) AS n FROM s GROUP BY ALL"""

assert math.pi == float(_PI.split(":")[0])

QUERIES = {
    f.__name__: f
    for f in (
        traj_error_summary, j1_asof_closed, j3_asof_interp, j5_asof_clamped, j6_heading_asof, j8_asof_backward, j11_sync, g17_reject_counts, g1_error_stats,
        g2_threshold_ratios, g21_overlap, g12_alignment, w1_sliding_ols, w3_heading, w5_jump_filter, w6_gap_fill, a9_throttle, f7_open_gate, t6_gap_sessions,
    )
}
ORACLES = {
    "traj_error_summary": f"WITH {ERRORS_SQL} SELECT vehicle_id, {STATS_SQL.format(x='horizontal')}, {_shares} FROM errors GROUP BY 1",
    "j1_asof_closed": _asof_sql(""),
    "j3_asof_interp": _asof_sql("WHERE (t0 IS NOT NULL AND t1 IS NOT NULL) OR abs(t1 - t) <= 1e-9"),
    "j5_asof_clamped": _asof_sql("", clamped=True),
    "j6_heading_asof": _J6,
    "j8_asof_backward": _J8,
    "j11_sync": _J11,
    "g17_reject_counts": f"SELECT reason, count(*) AS n FROM ({_J11}) GROUP BY 1",
    "g1_error_stats": _G1,
    "g2_threshold_ratios": _G2,
    "g21_overlap": _G21,
    "g12_alignment": _G12,
    "w1_sliding_ols": _W1,
    "w3_heading": _W3,
    "w5_jump_filter": f"WITH RECURSIVE {_JUMPS} SELECT vehicle_id, seq, accepted FROM c",
    "w6_gap_fill": _W6,
    "a9_throttle": _A9,
    "f7_open_gate": _F7,
    "t6_gap_sessions": _T6,
}
