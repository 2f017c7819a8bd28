"""Evaluation queries made of several operators: shared intervals, corrected paths, verdicts, cleaning, crop centres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import asof, clean, evaluate, sinks
from fathomline.plans.q_frames import ORACLES as FRAME_SQL
from fathomline.plans.q_frames import g13_source_histogram
from fathomline.plans.q_tracks import DAY, STATS_SQL, rounded
from fathomline.sources.tables import SAMPLES_SQL, samples

HOLD = 5 * DAY
SERIES = {"vision": "click", "fusion": "purchase", "imu": "error"}


def e3_three_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error statistics of three series in the interval that they share with the reference."""
    named = {name: samples(spark, sf_dir, kind) for name, kind in SERIES.items()}
    out = evaluate.series_errors(named, samples(spark, sf_dir, "view"))
    return rounded(out.groupBy("vehicle_id", "series").agg(*evaluate.statistics(F.col("horizontal"))))


def _spans_sql(kinds: list[str]) -> str:
    """span: the interval that all kinds share, by vehicle."""
    ends = [f"(SELECT vehicle_id, min(t) AS lo, max(t) AS hi FROM samples WHERE kind = '{k}' GROUP BY 1) s{n}" for n, k in enumerate(kinds)]
    joined = ends[0] + "".join(f" JOIN {e} USING (vehicle_id)" for e in ends[1:])
    at = lambda f, c: f"{f}({', '.join(f's{n}.{c}' for n in range(len(kinds)))})"
    return f"span AS (SELECT vehicle_id, {at('greatest', 'lo')} AS start, {at('least', 'hi')} AS stop FROM {joined} WHERE {at('greatest', 'lo')} < {at('least', 'hi')})"


_NEAR = """hi AS (SELECT o.*, r.t AS t1, r.lon AS lon1, r.lat AS lat1 FROM o ASOF LEFT JOIN r ON o.vehicle_id = r.vehicle_id AND o.t <= r.t),
b AS (SELECT hi.*, r.t AS t0, r.lon AS lon0, r.lat AS lat0 FROM hi ASOF LEFT JOIN r ON hi.vehicle_id = r.vehicle_id AND hi.t > r.t)"""
_METRES = """radians(lon - rlon) * 6378137.0::DOUBLE * cos(radians((lat + rlat) / 2)) AS east, radians(lat - rlat) * 6378137.0::DOUBLE AS north"""


def _lerp(f: str) -> str:
    return f"CASE WHEN abs(t1 - t) <= 1e-9 THEN {f}1 WHEN t0 IS NULL THEN {f}1 WHEN t1 IS NULL THEN {f}0 ELSE {f}0 + (t - t0) / (t1 - t0) * ({f}1 - {f}0) END AS r{f}"


_E3 = f"""WITH {SAMPLES_SQL}, {_spans_sql(["click", "purchase", "error", "view"])},
c AS (SELECT s.*, start FROM samples s JOIN span USING (vehicle_id) WHERE t BETWEEN start AND stop), r AS (SELECT * FROM c WHERE kind = 'view'),
o AS (SELECT *, CASE kind WHEN 'click' THEN 'vision' WHEN 'purchase' THEN 'fusion' ELSE 'imu' END AS series FROM c WHERE kind IN ('click', 'purchase', 'error')),
{_NEAR}, m AS (SELECT *, {_lerp("lon")}, {_lerp("lat")} FROM b WHERE t1 IS NOT NULL AND (t0 IS NOT NULL OR abs(t1 - t) <= 1e-9)),
e AS (SELECT *, {_METRES} FROM m), d AS (SELECT vehicle_id, series, sqrt(east * east + north * north) AS horizontal FROM e)
SELECT vehicle_id, series, {STATS_SQL.format(x="horizontal")} FROM d GROUP BY 1, 2"""


def e7_corrected_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused positions from the end of the alignment on, less the offset that vision showed before it."""
    view, click, purchase = (samples(spark, sf_dir, k) for k in ("view", "click", "purchase"))
    return rounded(evaluate.corrected_path(purchase, click, view, HOLD).select("vehicle_id", "seq", "lon", "lat"), 9)


_E7 = f"""WITH {SAMPLES_SQL}, {_spans_sql(["click", "purchase", "view"])}, r AS (SELECT * FROM samples WHERE kind = 'view'),
o AS (SELECT s.*, t - start AS since FROM samples s JOIN span USING (vehicle_id) WHERE kind IN ('click', 'purchase') AND t BETWEEN start AND stop),
{_NEAR}, m AS (SELECT *, {_lerp("lon")}, {_lerp("lat")} FROM b), e AS (SELECT *, {_METRES} FROM m),
f AS (SELECT vehicle_id, avg(east) AS oe, avg(north) AS og FROM e WHERE kind = 'click' AND since >= 0 AND since < {HOLD} GROUP BY 1)
SELECT vehicle_id, seq, round(rlon + degrees((east - oe) / (6378137.0::DOUBLE * cos(radians(rlat)))), 9) AS lon, round(rlat + degrees((north - og) / 6378137.0::DOUBLE), 9) AS lat
FROM e JOIN f USING (vehicle_id) WHERE kind = 'purchase' AND since >= {HOLD}"""


def e10_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates, failed gates, their percentage and a verdict."""
    return rounded(evaluate.verdict(g13_source_histogram(spark, sf_dir)))


_E10 = f"""WITH h AS ({FRAME_SQL["g13_source_histogram"]}),
a AS (SELECT coalesce(sum(n), 0)::BIGINT AS n_rows, coalesce(sum(n) FILTER (source = 'visual_update'), 0)::BIGINT AS updates,
      coalesce(sum(n) FILTER (source = 'visual_reject_nis'), 0)::BIGINT AS gate_failed FROM h)
SELECT n_rows, updates, gate_failed, CASE WHEN updates + gate_failed > 0 THEN round(100.0::DOUBLE * gate_failed / (updates + gate_failed), 6) END AS failed_percent,
  CASE WHEN updates = 0 AND gate_failed = 0 THEN 'no_visual_update' WHEN updates = 0 THEN 'all_gates_failed' ELSE 'usable' END AS verdict FROM a"""


def e12_gnss_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference track without jumps, gaps filled, in the text formats of its file."""
    filled = clean.fill_rejected(clean.mark_jumps(samples(spark, sf_dir, "view"), 500.0))
    return sinks.csv_table(filled.select("vehicle_id", "seq", "t", "lon", "lat", "alt", "accepted"), {"t": 9, "lon": 10, "lat": 10, "alt": 6})


def t18_crop_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre of each frame's crop: a fused position of the last hour, else one of the last day, else the reference's."""
    fused = samples(spark, sf_dir, "purchase")
    frames = samples(spark, sf_dir, "signup").select("vehicle_id", "t", "seq")
    return rounded(asof.crop_centre(frames, fused, samples(spark, sf_dir, "view"), DAY / 24, DAY).select("vehicle_id", "seq", "centre", "lon", "lat"), 9)


_T18 = f"""WITH {SAMPLES_SQL}, q AS (SELECT vehicle_id, t, seq FROM samples WHERE kind = 'signup'), p AS (SELECT * FROM samples WHERE kind = 'purchase'),
r AS (SELECT * FROM samples WHERE kind = 'view'),
o AS (SELECT q.*, p.t AS tp, p.lon AS lonp, p.lat AS latp FROM q ASOF LEFT JOIN p ON q.vehicle_id = p.vehicle_id AND q.t >= p.t), {_NEAR},
m AS (SELECT *, {_lerp("lon")}, {_lerp("lat")} FROM b),
k AS (SELECT *, CASE WHEN t - tp <= 3600 THEN 'recent' WHEN t - tp <= 86400 THEN 'held' WHEN t1 IS NOT NULL AND (t0 IS NOT NULL OR abs(t1 - t) <= 1e-9) THEN 'reference' END AS centre FROM m)
SELECT vehicle_id, seq, centre, round(CASE WHEN centre = 'reference' THEN rlon WHEN centre IS NOT NULL THEN lonp END, 9) AS lon,
  round(CASE WHEN centre = 'reference' THEN rlat WHEN centre IS NOT NULL THEN latp END, 9) AS lat FROM k"""

QUERIES = {f.__name__: f for f in (e3_three_series, e7_corrected_path, e10_verdict, e12_gnss_cleaning, t18_crop_centre)}
ORACLES = {"e3_three_series": _E3, "e7_corrected_path": _E7, "e10_verdict": _E10, "t18_crop_centre": _T18}
