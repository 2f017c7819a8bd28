"""Queries of preintegration and of the position at every fix, over states whose attitude is a heading alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import rotations as rot
from fathomline.operators import anchors, fix_rate, inertial
from fathomline.operators import preintegration as pre
from fathomline.plans.q_tracks import DAY, rounded
from fathomline.sources.tables import SAMPLES_SQL, samples

#: The driver's events are ten hours apart, inertial samples a tenth of a second.
SCALE = 360_000.0
LATE = 0.013
LIMITS = pre.Limits(max_gap=0.2, top_speed=3.0)
GATES = anchors.Gates(max_age=DAY / SCALE, innovation=0.0)


def _scaled(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    return samples(spark, sf_dir, kind).withColumn("t", F.col("t") / SCALE)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero, psi = F.lit(0.0), F.radians(F.col("k").cast("double"))
    s, c = F.sin(psi), F.cos(psi)
    return _scaled(spark, sf_dir).select(
        "vehicle_id", "t", "seq", F.array(s, c, zero, c, -s, zero, zero, zero, F.lit(-1.0)).alias("r"),
        F.array((F.col("value") % 3) / 10, zero, F.lit(-inertial.GRAVITY)).alias("accel"), F.array(zero, zero, zero).alias("bias"),
        F.array(zero, zero, (F.col("k") - 50) / 1000).alias("turn"), F.array(zero, zero, zero).alias("integral"), F.array(zero, zero, zero).alias("drift"),
    )


def w12_preintegration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each vehicle moves between its views, a little late."""
    from pyspark.sql import Window

    f = _scaled(spark, sf_dir, "view").withColumn("t", F.col("t") + LATE)
    asked = f.withColumn("start", F.lag("t").over(Window.partitionBy("vehicle_id").orderBy("t"))).where("start IS NOT NULL")
    k = F.col("k").cast("double")
    asked = asked.select("vehicle_id", "seq", "start", F.col("t").alias("stop"), (k / 50).alias("yaw"), F.array((k - 50) / 10, F.lit(1.0), F.lit(0.5)).alias("velocity"))
    out = pre.preintegrate(asked, _states(spark, sf_dir), LIMITS)
    d, v = rot.parts(F.col("delta"), 3), rot.parts(F.col("delta_vel"), 3)
    return rounded(out.select("vehicle_id", "seq", "ok", d[0].alias("east"), d[1].alias("north"), d[2].alias("up"), v[0].alias("dv_east"), v[1].alias("dv_north"), v[2].alias("dv_up"), "mean_speed", "final_speed"))


def j7_state_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading and acceleration at each click, from the states of the other events on both sides."""
    states = _states(spark, sf_dir).join(samples(spark, sf_dir).where("kind <> 'click'").select("seq"), "seq")
    at = pre.between(_scaled(spark, sf_dir, "click").select("vehicle_id", "t", "seq"), states, LIMITS)
    r = F.col("state.r")
    return rounded(at.select("vehicle_id", "seq", F.get(r, F.lit(0)).alias("sin_heading"), F.get(r, F.lit(3)).alias("cos_heading"), F.get("state.accel", F.lit(0)).alias("ax")))


def _fix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    c = _scaled(spark, sf_dir, "click")
    given = c.select(
        "vehicle_id", "t", "seq", "lon", "lat", "alt", F.array((k - 50) / 10, F.lit(0.5), F.lit(0.0)).alias("vel"),
        F.when(k % 7 != 6, k / 20).alias("heading"), F.lit(100).alias("used"), F.lit(1.0).alias("inlier_ratio"), F.lit(0.0).alias("reproj"),
    )
    fixes = _scaled(spark, sf_dir, "view").select("vehicle_id", (F.col("t") + LATE).alias("t"), "seq")
    return fix_rate.positions(fixes, given, _states(spark, sf_dir), GATES, LIMITS)


def t11_fix_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor, speed, heading and reason of every view, a little late; clicks are the anchors."""
    return rounded(_fix_rows(spark, sf_dir).select("vehicle_id", "seq", "anchor_seq", "age", "alt", "speed", F.sin("heading").alias("sin_heading"), F.cos("heading").alias("cos_heading"), "heading_source", "failure_reason"))


_STATES_SQL = f"""
{SAMPLES_SQL},
st AS (SELECT vehicle_id, seq, kind, t / {SCALE}::DOUBLE AS t, radians(k::DOUBLE) AS psi, fmod(value, 3) / 10 AS ax, (k - 50) / 1000.0::DOUBLE AS wz, k FROM samples)"""
_LIMIT = "CASE WHEN sqrt({e} ** 2 + {n} ** 2) > 3.0 THEN 3.0 / sqrt({e} ** 2 + {n} ** 2) ELSE 1.0 END"
#: One piece from the knot before (psi0, ax0, t0) to psi, ax, t, with the yaw of the row.
_PIECE = """
  SELECT *, (ax0 + ax) / 2 * ((sin(psi0) + sin(psi)) / h * cos(yaw) - (cos(psi0) + cos(psi)) / h * sin(yaw)) AS ae,
         (ax0 + ax) / 2 * ((sin(psi0) + sin(psi)) / h * sin(yaw) + (cos(psi0) + cos(psi)) / h * cos(yaw)) AS an
  FROM (SELECT *, t - t0 AS dt, sqrt((sin(psi0) + sin(psi)) ** 2 + (cos(psi0) + cos(psi)) ** 2) AS h FROM {knots})"""
_DAMPED = {"e": "(c.ve + p.ae * p.dt) * exp(-0.05 * p.dt)", "n": "(c.vn + p.an * p.dt) * exp(-0.05 * p.dt)"}
_W12_SQL = f"""
WITH RECURSIVE {_STATES_SQL},
f AS (SELECT vehicle_id, seq, k, t + {LATE}::DOUBLE AS stop, lag(t + {LATE}::DOUBLE) OVER (PARTITION BY vehicle_id ORDER BY t) AS start FROM st WHERE kind = 'view'),
q AS MATERIALIZED (SELECT * FROM f WHERE start IS NOT NULL),
knots AS MATERIALIZED (
  SELECT q.vehicle_id, q.seq, q.k / 50.0::DOUBLE AS yaw, start AS t, psi + wz * (start - s.t) AS psi, ax FROM q ASOF JOIN st s ON s.vehicle_id = q.vehicle_id AND q.start >= s.t
  UNION ALL SELECT q.vehicle_id, q.seq, q.k / 50.0::DOUBLE, stop, psi + wz * (stop - s.t), ax FROM q ASOF JOIN st s ON s.vehicle_id = q.vehicle_id AND q.stop >= s.t
  UNION ALL SELECT q.vehicle_id, q.seq, q.k / 50.0::DOUBLE, s.t, psi, ax FROM q JOIN st s ON s.vehicle_id = q.vehicle_id AND s.t > q.start AND s.t < q.stop
), paired AS (
  SELECT *, row_number() OVER w - 1 AS i, lag(t) OVER w AS t0, lag(psi) OVER w AS psi0, lag(ax) OVER w AS ax0 FROM knots WINDOW w AS (PARTITION BY seq ORDER BY t)
), p AS MATERIALIZED ({_PIECE.format(knots="paired")}),
c AS (
  SELECT seq, 0::BIGINT AS i, 0.0::DOUBLE AS e, 0.0::DOUBLE AS n, 0.0::DOUBLE AS u, (k - 50) / 10.0::DOUBLE AS ve, 1.0::DOUBLE AS vn, 0.5::DOUBLE AS vu, true AS ok FROM q
  UNION ALL
  SELECT seq, i, e, n, u, de * lim, dn * lim, du, ok FROM (
    SELECT *, {_LIMIT.format(e="de", n="dn")} AS lim FROM (
      SELECT p.seq, p.i, c.e + c.ve * p.dt + 0.5 * p.ae * p.dt * p.dt AS e, c.n + c.vn * p.dt + 0.5 * p.an * p.dt * p.dt AS n, c.u + c.vu * p.dt AS u,
             {_DAMPED["e"]} AS de, {_DAMPED["n"]} AS dn, c.vu * exp(-0.2 * p.dt) AS du, c.ok AND p.dt <= 0.2 AS ok
      FROM c JOIN p ON p.seq = c.seq AND p.i = c.i + 1))
), done AS (SELECT seq, arg_max(struct_pack(e := e, n := n, u := u, ve := ve, vn := vn, vu := vu, ok := ok), i) AS r FROM c GROUP BY seq)
SELECT q.vehicle_id, q.seq, r.ok AS ok, CASE WHEN r.ok THEN round(r.e, 6) + 0.0 END AS east, CASE WHEN r.ok THEN round(r.n, 6) + 0.0 END AS north, CASE WHEN r.ok THEN round(r.u, 6) + 0.0 END AS up,
       CASE WHEN r.ok THEN round(r.ve - (q.k - 50) / 10.0::DOUBLE, 6) + 0.0 END AS dv_east, CASE WHEN r.ok THEN round(r.vn - 1.0, 6) + 0.0 END AS dv_north, CASE WHEN r.ok THEN round(r.vu - 0.5, 6) + 0.0 END AS dv_up,
       CASE WHEN r.ok THEN round(sqrt(r.e ** 2 + r.n ** 2 + r.u ** 2) / (q.stop - q.start), 6) + 0.0 END AS mean_speed,
       CASE WHEN r.ok THEN round(sqrt(r.ve ** 2 + r.vn ** 2 + r.vu ** 2), 6) + 0.0 END AS final_speed
FROM q JOIN done USING (seq)
"""
_J7_SQL = f"""
WITH {_STATES_SQL},
s AS (SELECT * FROM st WHERE kind <> 'click'), c AS (SELECT * FROM st WHERE kind = 'click'),
a AS (SELECT c.vehicle_id, c.seq, c.t, s.t AS t0, s.psi AS psi0, s.ax AS ax0, s.wz AS wz0 FROM c ASOF LEFT JOIN s ON c.vehicle_id = s.vehicle_id AND c.t > s.t),
b AS (SELECT a.*, s.t AS t1, s.ax AS ax1, s.wz AS wz1 FROM a ASOF LEFT JOIN s ON a.vehicle_id = s.vehicle_id AND a.t <= s.t),
h AS (SELECT *, CASE WHEN t1 IS NOT NULL AND t0 IS NOT NULL THEN (t - t0) / (t1 - t0) END AS w FROM b)
SELECT vehicle_id, seq, round(sin(psi0 + (wz0 * (1 - w) + wz1 * w) * (t - t0)), 6) + 0.0 AS sin_heading, round(cos(psi0 + (wz0 * (1 - w) + wz1 * w) * (t - t0)), 6) + 0.0 AS cos_heading,
       round(ax0 * (1 - w) + ax1 * w, 6) + 0.0 AS ax FROM h
"""
_T11_SQL = f"""
WITH RECURSIVE {_STATES_SQL},
anchor AS (SELECT s.*, x.alt, CASE WHEN s.k % 7 <> 6 THEN s.k / 20.0::DOUBLE END AS compass FROM st s JOIN samples x USING (seq) WHERE s.kind = 'click'),
fixed AS (
  SELECT f.vehicle_id, f.seq, f.ft, a.seq AS a, a.t AS a_t, f.ft - a.t AS age, min(f.ft) OVER (PARTITION BY a.seq) - a.t <= {GATES.max_age}::DOUBLE AS adopted
  FROM (SELECT vehicle_id, seq, t + {LATE}::DOUBLE AS ft FROM st WHERE kind = 'view') f ASOF LEFT JOIN anchor a ON a.vehicle_id = f.vehicle_id AND f.ft >= a.t
), live AS MATERIALIZED (SELECT * FROM fixed WHERE a IS NOT NULL AND age <= {GATES.max_age}::DOUBLE),
spans AS MATERIALIZED (SELECT a, any_value(vehicle_id) AS vehicle_id, any_value(a_t) AS a_t, max(ft) AS stop FROM live GROUP BY a),
knots AS MATERIALIZED (
  SELECT a.seq AS a, a.t, psi, ax, NULL::BIGINT AS fix FROM anchor a JOIN spans ON spans.a = a.seq
  UNION ALL SELECT l.a, l.ft, psi + wz * (l.ft - s.t), ax, l.seq FROM live l ASOF JOIN st s ON s.vehicle_id = l.vehicle_id AND l.ft >= s.t
  UNION ALL SELECT x.a, s.t, psi, ax, NULL FROM spans x JOIN st s ON s.vehicle_id = x.vehicle_id AND s.t > x.a_t AND s.t < x.stop
), paired AS (
  SELECT n.*, row_number() OVER w - 1 AS i, lag(n.t) OVER w AS t0, lag(n.psi) OVER w AS psi0, lag(n.ax) OVER w AS ax0, g.psi - g.compass AS yaw
  FROM knots n JOIN anchor g ON g.seq = n.a WINDOW w AS (PARTITION BY n.a ORDER BY n.t)
), p AS MATERIALIZED ({_PIECE.format(knots="paired")}),
c AS (
  SELECT g.seq AS a, 0::BIGINT AS i, (g.k - 50) / 10.0::DOUBLE AS ve, 0.5::DOUBLE AS vn, 0.0::DOUBLE AS vu, g.compass IS NOT NULL AS ok, NULL::BIGINT AS fix, g.psi FROM anchor g JOIN spans ON spans.a = g.seq
  UNION ALL
  SELECT a, i, de * lim, dn * lim, du, ok, fix, psi FROM (
    SELECT *, {_LIMIT.format(e="de", n="dn")} AS lim FROM (
      SELECT p.a, p.i, {_DAMPED["e"]} AS de, {_DAMPED["n"]} AS dn, c.vu * exp(-0.2 * p.dt) AS du, c.ok AND p.dt <= 0.2 AS ok, p.fix, p.psi
      FROM c JOIN p ON p.a = c.a AND p.i = c.i + 1))
), told AS (
  SELECT f.*, c.ok, c.ve, c.vn, c.vu, c.psi, g.alt, g.compass, g.psi AS psi_a,
         count(*) FILTER (NOT c.ok) OVER (PARTITION BY f.a ORDER BY f.ft ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failed_before,
         bool_or(NOT c.ok) OVER (PARTITION BY f.a ORDER BY f.ft) AS failed
  FROM fixed f LEFT JOIN c ON c.fix = f.seq LEFT JOIN anchor g ON g.seq = f.a
), shown AS (SELECT *, a IS NOT NULL AND age <= {GATES.max_age}::DOUBLE AND coalesce(failed_before, 0) = 0 AS has_anchor FROM told)
SELECT vehicle_id, seq, CASE WHEN has_anchor THEN a END AS anchor_seq, CASE WHEN has_anchor THEN round(age, 6) + 0.0 END AS age, CASE WHEN has_anchor AND ok THEN round(alt, 6) + 0.0 END AS alt,
       CASE WHEN has_anchor AND ok THEN round(sqrt(ve ** 2 + vn ** 2), 6) + 0.0 END AS speed,
       CASE WHEN has_anchor AND ok THEN round(sin(compass + psi - psi_a), 6) + 0.0 END AS sin_heading, CASE WHEN has_anchor AND ok THEN round(cos(compass + psi - psi_a), 6) + 0.0 END AS cos_heading,
       CASE WHEN has_anchor AND ok THEN 'anchor+imu_delta' END AS heading_source,
       CASE WHEN has_anchor AND ok THEN NULL WHEN a IS NULL THEN 'no_visual_anchor' WHEN failed THEN 'imu_preintegration_failed' WHEN adopted THEN 'visual_anchor_expired' ELSE 'anchor_rejected_stale' END AS failure_reason
FROM shown
"""

QUERIES = {f.__name__: f for f in (w12_preintegration, j7_state_between, t11_fix_positions)}
ORACLES = {"w12_preintegration": _W12_SQL, "j7_state_between": _J7_SQL, "t11_fix_positions": _T11_SQL}
