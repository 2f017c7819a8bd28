"""Attitude and acceleration from inertial samples: a complementary filter per vehicle.

Body axes are forward, right, down; at rest the accelerometer reads the opposite of gravity.  The
filter is a recurrence over a vehicle's samples; samples whose time doesn't advance are dropped.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.geo import finite
from fathomline.plans.fold import fold_sorted

GRAVITY = 9.80665
AXES = ("gx", "gy", "gz", "ax", "ay", "az")


@dataclass(frozen=True)
class Tuning:
    start_samples: int = 20
    kp: float = 0.8
    ki: float = 0.02
    integral_limit: float = 0.1
    smoothing: float = 0.1
    norm_low: float = 7.0
    norm_high: float = 13.0
    bias_rate: float = 0.002
    bias_gyro: float = 0.08
    bias_residual: float = 0.8
    bias_limit: float = 0.6
    clean_every: int = 200


Vector = tuple[float, float, float]
#: A matrix by its rows.
Matrix = tuple[Vector, Vector, Vector]


def dot(a: Vector, b: Vector) -> float:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vector) -> float:
    return math.sqrt(dot(a, a))


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def combined(p: float, a: Vector, q: float, b: Vector) -> Vector:
    """p a + q b."""
    return p * a[0] + q * b[0], p * a[1] + q * b[1], p * a[2] + q * b[2]


def product(a: Matrix, b: Matrix) -> Matrix:
    columns = tuple(zip(*b, strict=True))
    return tuple(tuple(dot(row, c) for c in columns) for row in a)


def orthonormal(r: Matrix) -> Matrix:
    """Gram-Schmidt on the first two columns."""
    one, two, _ = zip(*r, strict=True)
    x = combined(1 / norm(one), one, 0.0, one)
    y = combined(1.0, two, -dot(x, two), x)
    y = combined(1 / norm(y), y, 0.0, y)
    return tuple(zip(x, y, cross(x, y), strict=True))


def rotation(v: Vector) -> Matrix:
    """Rodrigues' formula for a rotation vector."""
    x, y, z = v
    angle = norm(v)
    if angle < 1e-12:
        return (1.0, -z, y), (z, 1.0, -x), (-y, x, 1.0)
    s, c = math.sin(angle) / angle, (1 - math.cos(angle)) / angle**2
    return (
        (1 - c * (y * y + z * z), c * x * y - s * z, c * x * z + s * y),
        (c * x * y + s * z, 1 - c * (x * x + z * z), c * y * z - s * x),
        (c * x * z - s * y, c * y * z + s * x, 1 - c * (x * x + y * y)),
    )


def level_attitude(accel: Vector) -> Matrix:
    """World (east, north, up) from body, heading north, with the roll and pitch that gravity shows."""
    x, y, z = (-a for a in accel)
    roll = math.atan2(y, z)
    pitch = math.atan2(-x, math.hypot(y, z))
    cr, sr, cp, sp = math.cos(roll), math.sin(roll), math.cos(pitch), math.sin(pitch)
    return (0.0, cr, -sr), (cp, sp * sr, sp * cr), (sp, -cp * sr, -cp * cr)


def roll_pitch(clean: Matrix) -> tuple[float, float]:
    """Degrees, of an orthonormal attitude."""
    x, y, z = (-a for a in clean[2])
    return math.degrees(math.atan2(y, z)), math.degrees(math.atan2(-x, math.hypot(y, z)))


ZERO: Vector = (0.0, 0.0, 0.0)


@dataclass
class Attitude:
    """State between two samples; clean: r with orthonormal columns."""

    early: list = field(default_factory=list)
    t: float = -math.inf
    gyro: Vector | None = None
    accel: Vector | None = None
    r: Matrix | None = None
    clean: Matrix | None = None
    smooth: Vector | None = None
    integral: Vector = ZERO
    bias: Vector = ZERO
    steps: int = 0

    def holding(self, k: Tuning) -> tuple[Vector, Vector]:
        """How the attitude turns on from the last sample: the rate without the integral term, and the growth of that term a second."""
        smooth = combined(1 - k.smoothing, self.smooth, k.smoothing, self.accel)
        size = norm(smooth)
        if not (k.norm_low <= norm(self.accel) <= k.norm_high and k.norm_low <= size <= k.norm_high):
            return self.gyro, ZERO
        error = cross(combined(1 / size, smooth, 0.0, smooth), combined(1 / norm(self.r[2]), self.r[2], 0.0, self.r[2]))
        return combined(1.0, self.gyro, k.kp, error), combined(k.ki, error, 0.0, ZERO)

    def advance(self, t: float, gyro: Vector, accel: Vector, k: Tuning) -> bool:
        """Take a sample; whether there is an attitude for it."""
        if t <= self.t:
            return False
        if self.r is None:
            self.early.append(accel)
            self.t, self.gyro, self.accel = t, gyro, accel
            if len(self.early) < k.start_samples:
                return False
            self.smooth = tuple(math.fsum(axis) / len(self.early) for axis in zip(*self.early, strict=True))
            self.r, self.early = level_attitude(self.smooth), []
            self.clean = orthonormal(self.r)
            return True
        dt, mid_gyro, mid_accel = t - self.t, combined(0.5, self.gyro, 0.5, gyro), combined(0.5, self.accel, 0.5, accel)
        turn = mid_gyro
        self.smooth = combined(1 - k.smoothing, self.smooth, k.smoothing, mid_accel)
        size = norm(self.smooth)
        if k.norm_low <= norm(mid_accel) <= k.norm_high and k.norm_low <= size <= k.norm_high:
            # seen and expected both point down; minus times minus cancels
            error = cross(combined(1 / size, self.smooth, 0.0, self.smooth), combined(1 / norm(self.r[2]), self.r[2], 0.0, self.r[2]))
            if k.ki > 0:
                self.integral = combined(1.0, self.integral, k.ki * dt, error)
                length = norm(self.integral)
                if 0 < k.integral_limit < length:
                    self.integral = combined(k.integral_limit / length, self.integral, 0.0, ZERO)
            turn = combined(1.0, combined(1.0, turn, k.kp, error), 1.0, self.integral)
        self.r = product(self.r, rotation(combined(dt, turn, 0.0, ZERO)))
        self.steps += 1
        self.clean = orthonormal(self.r)
        if self.steps % k.clean_every == 0:
            self.r = self.clean
        if k.bias_rate > 0 and norm(mid_gyro) <= k.bias_gyro:
            rest = combined(1.0, mid_accel, -GRAVITY, self.clean[2])
            if norm(rest) <= k.bias_residual:
                moved = combined(1 - k.bias_rate, self.bias, k.bias_rate, rest)
                self.bias = tuple(max(-k.bias_limit, min(k.bias_limit, b)) for b in moved)
        self.t, self.gyro, self.accel = t, gyro, accel
        return True


def attitudes(imu: DataFrame, tuning: Tuning | None = None, by: str = "vehicle_id") -> DataFrame:
    """by, t, seq, roll, pitch (degrees), heading (relative, radians clockwise) and the acceleration east, north, up without gravity.

    imu: by, t, seq and gx to az; rows with a value that isn't finite are dropped.  The first rows of a
    vehicle, which its starting attitude is averaged from, give nothing.
    """
    k = tuning or Tuning()

    def step(state, row):
        state = state or Attitude()
        _, t, seq, *axes = row
        if not state.advance(t, tuple(axes[:3]), tuple(axes[3:]), k):
            return state, []
        roll, pitch = roll_pitch(state.clean)
        own = combined(1.0, state.accel, -1.0, state.bias)
        east, north, up = (dot(axis, own) for axis in state.clean)
        return state, [(row[0], t, seq, roll, pitch, math.atan2(state.r[0][0], state.r[1][0]), east, north, up - GRAVITY)]

    return _folded(imu, step, "roll double,pitch double,heading double,a_east double,a_north double,a_up double", by)


def states(imu: DataFrame, tuning: Tuning | None = None, by: str = "vehicle_id") -> DataFrame:
    """by, t, seq and the tracker's state after each sample: r (attitude, by rows), accel, bias, turn and drift (how it goes on) and integral.

    The integral counts into turn where the accelerometer can be trusted; elsewhere integral is zero.
    """
    k = tuning or Tuning()

    def step(state, row):
        state = state or Attitude()
        _, t, seq, *axes = row
        if not state.advance(t, tuple(axes[:3]), tuple(axes[3:]), k):
            return state, []
        turn, drift = state.holding(k)
        trusted = turn is not state.gyro
        return state, [(row[0], t, seq, [x for line in state.r for x in line], list(state.accel), list(state.bias), list(turn), list(state.integral if trusted else ZERO), list(drift))]

    return _folded(imu, step, ",".join(f"{n} array<double>" for n in ("r", "accel", "bias", "turn", "integral", "drift")), by)


def _folded(imu: DataFrame, step, out: str, by: str) -> DataFrame:
    given = imu.where(finite(F.col("t"), *map(F.col, AXES)) & (F.col("t") > 0)).select(by, "t", "seq", *[F.col(a).cast("double").alias(a) for a in AXES])
    kinds = {c: given.schema[c].dataType.simpleString() for c in (by, "seq")}
    return fold_sorted(given, by, ["t", "seq"], step, f"{by} {kinds[by]},t double,seq {kinds['seq']},{out}")
