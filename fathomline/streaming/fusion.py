"""Fusion of inertial accelerations with late absolute positions: one Kalman filter per vehicle.

State: position and velocity east, north, up, and the covariance of the position.  Events of a vehicle:

* "imu": acceleration; position and velocity are propagated with damping and speed limits, and each
  axis' variance grows by the random walk and a quarter of the acceleration variance times dt**4.  After a
  gap of more than max_gap the velocity is lost and the variance grows by what may have happened.
* "visual": position with its covariance.  The first starts the filter, one after reinit_gap seconds
  without any restarts it, others pass a gate on the normalised innovation squared and correct the
  position only (Joseph form).  The scale of visual covariances follows the innovations.  One that a
  quality check has turned down carries the reason, and one whose position isn't finite is turned down
  as "visual_reject_invalid_pose": both only move the filter to their time, under that source.

* "close": the gate has closed.  The filter and its history are forgotten; only the scale of visual
  covariances stays.

Accelerations that aren't finite are dropped, as are visual events with a covariance that isn't.

`fuse` runs over a table in event time.  `fuse_stream` runs over a stream in order of arrival: a
visual event older than the state, but not by more than max_lag, is applied at its own time from a
kept snapshot, and the inertial events since are applied again; an older one is dropped.  Both
share `Filter.apply`.  Ties go imu before visual.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.plans.fold import fold_sorted

KINDS = {"imu": 0, "visual": 1, "close": 2}
OUT = "t double,seq bigint,source string,east double,north double,up double,var_e double,var_n double,var_u double,speed double,nis double"
EVENT = ("t", "seq", "kind", "x", "y", "z", "vx", "vy", "vz")
#: Covariances east-north, east-up and north-up, and the reason of a rejection; a stream may lack them.
MORE = {"cen": "double", "ceu": "double", "cnu": "double", "bad": "string"}
INVALID = "visual_reject_invalid_pose"

Matrix = list[list[float]]


def _sound(*values: float | None) -> bool:
    return all(v is not None and math.isfinite(v) for v in values)


def _plus(a: Matrix, b: Matrix) -> Matrix:
    return [[x + y for x, y in zip(p, q, strict=True)] for p, q in zip(a, b, strict=True)]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return [[sum(x * y for x, y in zip(row, column, strict=True)) for column in zip(*b, strict=True)] for row in a]


def _diagonal(*values: float) -> Matrix:
    return [[v if i == j else 0.0 for j in range(3)] for i, v in enumerate(values)]


def _inverse(m: Matrix) -> Matrix:
    """By cofactors; the pseudo-inverse of a singular matrix."""
    (a, b, c), (d, e, f), (g, h, i) = m
    cofactors = [[e * i - f * h, c * h - b * i, b * f - c * e], [f * g - d * i, a * i - c * g, c * d - a * f], [d * h - e * g, b * g - a * h, a * e - b * d]]
    size = a * cofactors[0][0] + b * cofactors[1][0] + c * cofactors[2][0]
    if abs(size) <= 1e-12 * max(1e-300, abs(a * e * i)):
        return np.linalg.pinv(np.array(m)).tolist()
    return [[x / size for x in row] for row in cofactors]


@dataclass(frozen=True)
class Tuning:
    walk_xy: float = 0.55
    walk_z: float = 0.4
    accel_sigma: float = 0.8
    max_gap: float = 0.2
    reinit_gap: float = 1.5
    nis_gate: float = 16.266
    reject_on_gate: bool = True
    nis_target: float = 3.0
    nis_power: float = 0.5
    scale_low: float = 0.5
    scale_high: float = 4.0
    adaptive: bool = False
    damping: float = 0.05
    damping_z: float = 0.2
    top_speed: float = 60.0
    top_climb: float = 10.0
    max_lag: float = 3.0


@dataclass
class Filter:
    t: float | None = None
    pos: list = field(default_factory=lambda: [0.0, 0.0, 0.0])
    vel: list = field(default_factory=lambda: [0.0, 0.0, 0.0])
    cov: list = field(default_factory=lambda: _diagonal(0.0, 0.0, 0.0))
    last_visual: float | None = None
    scale: float = 1.0

    @property
    def var(self) -> list[float]:
        return [self.cov[k][k] for k in range(3)]

    def _propagate(self, t: float, accel: tuple, k: Tuning) -> str:
        dt = t - self.t
        if dt <= 1e-9:
            return "imu_predict"
        if dt > k.max_gap + 1e-9:
            reach = 0.5 * k.accel_sigma * dt * dt
            flat = max(5.0, math.hypot(*self.vel) * dt + reach) ** 2
            climb = max(3.0, abs(self.vel[2]) * dt + reach) ** 2
            self.cov = _plus(self.cov, _diagonal(flat, flat, climb))
            self.vel, self.t = [0.0, 0.0, 0.0], t
            return "imu_gap_restart"
        self.pos = [p + v * dt + 0.5 * a * dt * dt for p, v, a in zip(self.pos, self.vel, accel, strict=True)]
        v = [v + a * dt for v, a in zip(self.vel, accel, strict=True)]
        flat, climb = math.exp(-k.damping * dt), math.exp(-k.damping_z * dt)
        v = [v[0] * flat, v[1] * flat, v[2] * climb]
        speed = math.hypot(v[0], v[1])
        if 0 < k.top_speed < speed:
            v[0], v[1] = v[0] * k.top_speed / speed, v[1] * k.top_speed / speed
        if k.top_climb > 0:
            v[2] = max(-k.top_climb, min(k.top_climb, v[2]))
        grown = 0.25 * k.accel_sigma**2 * dt**4
        walk = _diagonal(k.walk_xy**2 * dt + grown, k.walk_xy**2 * dt + grown, k.walk_z**2 * dt + grown)
        self.vel, self.cov, self.t = v, _plus(self.cov, walk), t
        return "imu_predict"

    def _correct(self, t: float, z: tuple, r: Matrix, bad: str | None, k: Tuning) -> tuple[str, float | None]:
        started = self.t is not None
        if bad:
            if t > self.t:
                self._propagate(t, (0.0, 0.0, 0.0), k)
            self.t = t
            return bad, None
        noise = [[x * self.scale for x in row] for row in r]
        late = started and k.reinit_gap > 0 and self.last_visual is not None and t - self.last_visual > k.reinit_gap
        if not started or late:
            self.t, self.pos, self.cov, self.last_visual = t, list(z), noise, t
            return ("visual_reinit_after_gap" if late else "visual_init"), None
        if t > self.t:
            self._propagate(t, (0.0, 0.0, 0.0), k)
        gap = [a - b for a, b in zip(z, self.pos, strict=True)]
        inverse = _inverse(_plus(self.cov, noise))
        nis = sum(g * sum(x * h for x, h in zip(row, gap, strict=True)) for g, row in zip(gap, inverse, strict=True))
        if k.adaptive and math.isfinite(nis):
            moved = self.scale * max(0.25, min(4.0, nis / k.nis_target)) ** k.nis_power
            self.scale = max(k.scale_low, min(k.scale_high, moved))
        self.t = t
        if k.reject_on_gate and k.nis_gate > 0 and nis > k.nis_gate:
            return "visual_reject_nis", nis
        gain = _times(self.cov, inverse)
        self.pos = [p + sum(g * d for g, d in zip(row, gap, strict=True)) for p, row in zip(self.pos, gain, strict=True)]
        rest = [[(i == j) - x for j, x in enumerate(row)] for i, row in enumerate(gain)]
        across = lambda m, c: _times(_times(m, c), [list(column) for column in zip(*m, strict=True)])
        self.cov = _plus(across(rest, self.cov), across(gain, noise))
        self.last_visual = t
        return "visual_update", nis

    def apply(self, event: tuple, k: Tuning) -> tuple | None:
        """An output row (OUT), or None before the filter has started and for what is dropped; event: EVENT, with or without MORE."""
        t, seq, kind, x, y, z, vx, vy, vz, *more = event
        nis = None
        if kind == KINDS["close"]:
            self.__init__(scale=self.scale)
            return None
        if kind == KINDS["imu"]:
            if self.t is None or t < self.t or not _sound(x, y, z):
                return None
            source = self._propagate(t, (x, y, z), k)
        else:
            *off, bad = more or (None, None, None, None)
            en, eu, nu = (c if c is not None and c == c else 0.0 for c in off)
            bad = bad if isinstance(bad, str) else None if _sound(x, y, z) else INVALID
            if (bad and self.t is None) or not _sound(vx, vy, vz, en, eu, nu):
                return None
            source, nis = self._correct(t, (x, y, z), [[vx, en, eu], [en, vy, nu], [eu, nu, vz]], bad, k)
        return (t, seq, source, *self.pos, *self.var, math.hypot(*self.vel), nis)


def events(imu: DataFrame, visual: DataFrame, closes: DataFrame | None = None, by: str = "vehicle_id") -> DataFrame:
    """One table of events from accelerations (a_east, a_north, a_up) and positions (east, north, up, var_e, var_n, var_u).

    Positions may have cov_en, cov_eu, cov_nu (zero where they lack) and reason (of a failed quality check).  closes: by, t, seq
    of the rows at which the gate closes (`clean.open_gate`, edge "close").
    """

    def rows(df: DataFrame, kind: str, names: list[str | None]) -> DataFrame:
        columns = dict(zip((*EVENT[3:], *MORE), names, strict=True))
        picked = [(F.col(c) if c in df.columns else F.lit(None)).cast(MORE.get(n, "double")).alias(n) for n, c in columns.items()]
        return df.select(by, "t", F.col("seq").cast("long").alias("seq"), F.lit(KINDS[kind]).alias("kind"), *picked)

    accelerations = rows(imu, "imu", ["a_east", "a_north", "a_up", *[None] * 7])
    every = accelerations if closes is None else accelerations.unionByName(rows(closes, "close", [None] * 10))
    return every.unionByName(rows(visual, "visual", ["east", "north", "up", "var_e", "var_n", "var_u", "cov_en", "cov_eu", "cov_nu", "reason"]))


def _whole(stream: DataFrame, by: str) -> DataFrame:
    return stream.select(by, *EVENT, *[F.col(c) if c in stream.columns else F.lit(None).cast(k).alias(c) for c, k in MORE.items()])


def fuse(stream: DataFrame, tuning: Tuning | None = None, by: str = "vehicle_id") -> DataFrame:
    """Every vehicle's filtered rows, in event time."""
    k = tuning or Tuning()

    def step(state, row):
        state = state or Filter()
        out = state.apply(row[1:], k)
        return state, [(row[0], *out)] if out else []

    kind = stream.schema[by].dataType.simpleString()
    return fold_sorted(_whole(stream, by), by, ["t", "kind", "seq"], step, f"{by} {kind},{OUT}")


@dataclass
class Tracker:
    """A filter with the snapshots and events of the last max_lag seconds, for late visual events."""

    now: Filter = field(default_factory=Filter)
    past: list = field(default_factory=list)  # (event, filter before it)

    def take(self, event: tuple, k: Tuning) -> list[tuple]:
        if event[2] == KINDS["close"]:
            self.now.apply(event, k)
            self.past = []
            return []
        late = self.now.t is not None and event[0] + 1e-9 < self.now.t
        if not late:
            self.past.append((event, asdict(self.now)))
            row = self.now.apply(event, k)
            self.past = [(e, f) for e, f in self.past if e[0] >= event[0] - k.max_lag]
            return [row] if row else []
        if event[2] == KINDS["imu"] or self.now.t - event[0] > k.max_lag:
            return []
        later = [(e, f) for e, f in self.past if e[0] > event[0]]
        if not later:
            return []
        self.past = [(e, f) for e, f in self.past if e[0] <= event[0]]
        self.now = Filter(**later[0][1])
        self.past.append((event, asdict(self.now)))
        row = self.now.apply(event, k)
        for e, _ in later:
            self.past.append((e, asdict(self.now)))
            self.now.apply(e, k)
        return [(*row[:2], row[2] + "_replayed", *row[3:])] if row else []

    def dump(self) -> str:
        return json.dumps([asdict(self.now), self.past])

    @classmethod
    def load(cls, text: str) -> Tracker:
        now, past = json.loads(text)
        return cls(Filter(**now), [(tuple(e), f) for e, f in past])


def fuse_stream(stream: DataFrame, tuning: Tuning | None = None, by: str = "vehicle_id") -> DataFrame:
    """The same over a stream, in order of arrival within micro-batches sorted by time."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    k = tuning or Tuning()
    kind = stream.schema[by].dataType.simpleString()
    names = [by, *[part.split()[0] for part in OUT.split(",")]]

    def work(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tracker = Tracker.load(state.get[0]) if state.exists else Tracker()
        rows = [row for frame in frames for row in frame[[*EVENT, *MORE]].itertuples(index=False, name=None)]
        out = []
        for row in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
            clean = tuple(None if isinstance(v, float) and math.isnan(v) else v for v in row)
            out += [(key[0], *made) for made in tracker.take((float(clean[0]), int(clean[1]), int(clean[2]), *clean[3:]), k)]
        state.update((tracker.dump(),))
        yield pd.DataFrame(out, columns=names)

    return _whole(stream, by).groupBy(by).applyInPandasWithState(work, f"{by} {kind},{OUT}", "state string", "append", GroupStateTimeout.NoTimeout)
