"""Preintegration: how far a vehicle moves between two times, by its attitude states alone.

States of a vehicle (`inertial.states`) cut a request's time into pieces; a piece has the mean
acceleration of its ends in the mean attitude of its ends, turned by the request's yaw, plus gravity.
Position and velocity are carried over the pieces, and the velocity is damped after each.  The ends of a
request that lie between states are states themselves, held forward from the state before (never from a
later one).  A piece longer than max_gap makes the request fail.

Damping is linear, so what a run of pieces does to (position, velocity) is an affine map, and these
compose associatively: every block of time is composed on its own, in parallel, and a request's blocks
are composed after.  Only speed limits aren't linear.  A request whose speed could reach one (a bound
from the composed maps) is carried piece by piece.

Defined results: a request that ends where it starts moves by nothing; one that ends before it starts,
has no state at or before its start, or a piece over max_gap, has ok false and nulls; null keys are one
key.  Requests are told apart by (by, seq).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import rotations as rot
from fathomline.functions.geo import finite
from fathomline.operators import asof
from fathomline.operators.inertial import GRAVITY

STATE = ["r", "accel", "bias", "turn", "integral", "drift"]
SAME = asof.SAME


@dataclass(frozen=True)
class Limits:
    max_gap: float = 0.2
    damping: float = 0.05
    damping_z: float = 0.2
    top_speed: float = 60.0
    top_climb: float = 10.0
    integral_limit: float = 0.1


def held(state: Column, t: Column, limits: Limits) -> Column:
    """A state held forward to t: the same samples, the attitude turned on by the rate at the state."""

    def on(s: Column) -> Column:
        dt = s["to"] - s["s"]["t"]
        integral = rot.limited(rot.added(s["s"]["integral"], rot.scaled(s["s"]["drift"], dt)), limits.integral_limit)
        turn = rot.rotation_of(rot.scaled(rot.added(s["s"]["turn"], integral), dt))
        r = F.when(dt > SAME, rot.product(s["s"]["r"], turn)).otherwise(s["s"]["r"])
        return F.struct(s["to"].alias("t"), r.alias("r"), s["s"]["accel"].alias("accel"), s["s"]["bias"].alias("bias"))

    return rot.let(F.struct(state.alias("s"), t.alias("to")), on)


def piece(a: Column, b: Column) -> Column:
    """t (of its end), dt and u (acceleration without bias, in the tracker's axes) of the piece between two states."""

    def made(s: Column) -> Column:
        half = lambda f: rot.scaled(rot.added(s["a"][f], s["b"][f]), 0.5)
        own = F.zip_with(half("accel"), half("bias"), lambda x, y: x - y)
        return F.struct(s["b"]["t"].alias("t"), (s["b"]["t"] - s["a"]["t"]).alias("dt"), rot.turned(half("r"), own).alias("u"))

    return rot.let(F.struct(a.alias("a"), b.alias("b")), made)


def pieces(requests: DataFrame, states: DataFrame, limits: Limits, by: str = "vehicle_id", width: float = 60.0) -> DataFrame:
    """by, seq and piece of every piece of every request (by, seq, start, stop), in no order; a request without states at its ends has a null piece.

    width: seconds of a bucket; states are joined to requests by buckets, so no vehicle is one task.
    """
    known = requests.where(F.col("start").isNotNull() & (F.col("stop") - F.col("start") > SAME)).select(by, "seq", "start", "stop")
    at = asof.neighbours(known.withColumn("t", F.col("start")), states, STATE, by=by, width=width)
    at = at.withColumnsRenamed({"before": "_b0", "after": "_a0"}).withColumn("t", F.col("stop"))
    at = asof.neighbours(at, states, STATE, by=by, width=width)
    on_start = F.coalesce(F.abs(F.col("_a0.t") - F.col("start")) <= SAME, F.lit(False))
    on_stop = F.coalesce(F.abs(F.col("after.t") - F.col("stop")) <= SAME, F.lit(False))
    at = at.withColumns({"_on_start": on_start, "_on_stop": on_stop})
    last = F.when(F.col("_on_stop"), F.col("after")).otherwise(F.col("before"))
    at = at.withColumn("_last", last).withColumn("_whole", ~F.col("_on_start") & (F.col("_last.t") < F.col("start")))
    at = at.withColumn("_begin", held(F.col("_b0"), F.col("start"), limits)).withColumn("_end", held(F.col("_last"), F.col("stop"), limits))
    bare = lambda s: F.struct(s["t"].alias("t"), s["r"].alias("r"), s["accel"].alias("accel"), s["bias"].alias("bias"))
    first_to = F.when(F.col("_whole"), F.col("_end")).otherwise(bare(F.col("_a0")))
    known_ends = F.col("_on_start") | F.col("_b0").isNotNull()
    head = F.when(~F.col("_on_start") & F.col("_b0").isNotNull(), piece(F.col("_begin"), first_to))
    tail = F.when(~F.col("_on_stop") & ~F.col("_whole"), piece(bare(F.col("_last")), F.col("_end")))
    ends = at.select(by, "seq", known_ends.alias("_known"), F.array_compact(F.array(head, tail)).alias("_p"))
    ends = ends.select(by, "seq", F.explode_outer(F.when(F.col("_known"), F.col("_p"))).alias("piece"), "_known").where(~F.col("_known") | F.col("piece").isNotNull())

    near = asof.neighbours(states, states, STATE, by=by, width=width).where(F.col("before").isNotNull())
    own = F.struct(F.col("t").alias("t"), *[F.col(f).alias(f) for f in STATE])
    inner = near.select(F.col(by).alias("_by"), F.col("before.t").alias("_from"), piece(F.col("before"), own).alias("piece"))
    inner = inner.withColumn("_bucket", F.floor(F.col("piece.t") / width))
    spread = known.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))
    inside = (F.col("_from") >= F.col("start") - SAME) & (F.col("piece.t") <= F.col("stop") + SAME)
    middle = spread.join(inner, spread[by].eqNullSafe(inner["_by"]) & (spread["_bucket"] == inner["_bucket"])).where(inside)
    return ends.select(by, "seq", "piece").unionByName(middle.select(by, "seq", "piece"))


#: What a run of pieces does: velocity v becomes e v + w, position moves by f v + q (horizontal e, f; vertical ez, fz).
MAP = "struct<e:double,ez:double,f:double,fz:double,w:array<double>,q:array<double>,peak:double,peak_z:double,longest:double>"
ZEROS = "array(0D, 0D, 0D)"


def _identity() -> Column:
    return F.expr(f"named_struct('e', 1D, 'ez', 1D, 'f', 0D, 'fz', 0D, 'w', {ZEROS}, 'q', {ZEROS}, 'peak', 0D, 'peak_z', 0D, 'longest', 0D)").cast(MAP)


def _mapped(e: Column, ez: Column, f: Column, fz: Column, w: list[Column], q: list[Column], *peaks: Column) -> Column:
    names = [c.alias(n) for c, n in zip((e, ez, f, fz, F.array(*w), F.array(*q), *peaks), ("e", "ez", "f", "fz", "w", "q", "peak", "peak_z", "longest"), strict=True)]
    return F.struct(*names).cast(MAP)


def _append(limits: Limits):
    def step(m: Column, p: Column) -> Column:
        dt, u = p["dt"], rot.parts(p["u"], 3)
        a = [u[0], u[1], u[2] - GRAVITY]
        decay = F.struct(F.exp(-limits.damping * dt).alias("d"), F.exp(-limits.damping_z * dt).alias("dz"))
        w, q = rot.parts(m["w"], 3), rot.parts(m["q"], 3)

        def after(s: Column) -> Column:
            moved = [q[k] + w[k] * dt + a[k] * (0.5 * dt * dt) for k in range(3)]
            fast = rot.parts(s["fast"], 3)
            return _mapped(
                m["e"] * s["d"], m["ez"] * s["dz"], m["f"] + m["e"] * dt, m["fz"] + m["ez"] * dt, fast, moved,
                F.greatest(m["peak"], F.hypot(fast[0], fast[1])), F.greatest(m["peak_z"], F.abs(fast[2])), F.greatest(m["longest"], dt),
            )

        def damped(s: Column) -> Column:
            return F.struct(s["d"].alias("d"), s["dz"].alias("dz"), F.array(*[(w[k] + a[k] * dt) * s["dz" if k == 2 else "d"] for k in range(3)]).alias("fast"))

        return rot.let(rot.let(decay, damped), after)

    return step


def _compose(a: Column, b: Column) -> Column:
    """First a, then b."""
    wa, qa, wb, qb = (rot.parts(c, 3) for c in (a["w"], a["q"], b["w"], b["q"]))
    w = [(b["ez"] if k == 2 else b["e"]) * wa[k] + wb[k] for k in range(3)]
    q = [qa[k] + (b["fz"] if k == 2 else b["f"]) * wa[k] + qb[k] for k in range(3)]
    return _mapped(
        a["e"] * b["e"], a["ez"] * b["ez"], a["f"] + b["f"] * a["e"], a["fz"] + b["fz"] * a["ez"], w, q,
        F.greatest(a["peak"], F.hypot(wa[0], wa[1]) + b["peak"]), F.greatest(a["peak_z"], F.abs(wa[2]) + b["peak_z"]), F.greatest(a["longest"], b["longest"]),
    )


def carried(state: Column, p: Column, yaw: Column, limits: Limits) -> Column:
    """(pos, vel, all right so far) after one piece, with the speed limits."""
    dt, u, v, pos = p["dt"], rot.parts(p["u"], 3), rot.parts(state["vel"], 3), rot.parts(state["pos"], 3)

    def moved(turn: Column) -> Column:
        a = [turn["c"] * u[0] - turn["s"] * u[1], turn["s"] * u[0] + turn["c"] * u[1], u[2] - GRAVITY]
        there = [pos[k] + v[k] * dt + a[k] * (0.5 * dt * dt) for k in range(3)]
        fast = [(v[k] + a[k] * dt) * F.exp(-(limits.damping_z if k == 2 else limits.damping) * dt) for k in range(3)]
        return F.struct(F.array(*there).alias("pos"), F.array(*fast).alias("vel"))

    def slowed(s: Column) -> Column:
        x, y, z = rot.parts(s["vel"], 3)
        if limits.top_speed > 0:
            over = F.when(s["speed"] > limits.top_speed, limits.top_speed / s["speed"]).otherwise(1.0)
            x, y = x * over, y * over
        if limits.top_climb > 0:
            z = F.greatest(F.lit(-limits.top_climb), F.least(F.lit(limits.top_climb), z))
        return F.struct(s["pos"].alias("pos"), F.array(x, y, z).alias("vel"), (state["ok"] & (dt <= limits.max_gap + SAME)).alias("ok"))

    with_speed = lambda s: F.struct(s["pos"].alias("pos"), s["vel"].alias("vel"), F.hypot(*rot.parts(s["vel"], 2)).alias("speed"))
    return rot.let(rot.let(rot.let(F.struct(F.cos(yaw).alias("c"), F.sin(yaw).alias("s")), moved), with_speed), slowed)


def start_state(velocity: Column) -> Column:
    return F.struct(F.expr(ZEROS).alias("pos"), velocity.alias("vel"), F.lit(True).alias("ok"))


def ordered(column: str = "piece") -> Column:
    """The pieces of a group in order; a missing one (no state at an end) stays as a null at the front."""
    return F.sort_array(F.collect_list(F.struct(F.col(f"{column}.t").alias("t"), F.col(column).alias("p"))))


def preintegrate(requests: DataFrame, states: DataFrame, limits: Limits | None = None, by: str = "vehicle_id", width: float = 60.0) -> DataFrame:
    """The columns of requests with ok, delta and delta_vel (east, north, up), mean_speed and final_speed.

    requests: by, seq, start, stop, yaw (radians from the tracker's axes to east and north) and velocity
    (array east, north, up at the start).
    """
    k = limits or Limits()
    given = pieces(requests, states, k, by, width)
    block = F.floor(F.col("piece.t") / width)
    local = given.groupBy(by, "seq", block.alias("_block")).agg(ordered().alias("_p"))
    local = local.withColumn("_lost", F.exists("_p", lambda x: x["p"].isNull()))
    local = local.withColumn("_map", F.aggregate(F.filter("_p", lambda x: x["p"].isNotNull()), _identity(), lambda m, x: _append(k)(m, x["p"])))
    blocks = F.sort_array(F.collect_list(F.struct("_block", "_map")))
    maps = local.groupBy(F.col(by).alias("_by"), F.col("seq").alias("_seq")).agg(blocks.alias("_m"), F.max("_lost").alias("_lost"))
    maps = maps.withColumn("_map", F.aggregate("_m", _identity(), lambda m, x: _compose(m, x["_map"]))).drop("_m")
    met = requests.join(maps, requests[by].eqNullSafe(F.col("_by")) & (F.col("seq") == F.col("_seq")), "left").drop("_by", "_seq")

    v, m = rot.parts(F.col("velocity"), 3), F.col("_map")
    reach = F.hypot(v[0], v[1]) + m["peak"]
    fast = (F.lit(k.top_speed > 0) & (reach > k.top_speed)) | (F.lit(k.top_climb > 0) & (F.abs(v[2]) + m["peak_z"] > k.top_climb))
    still = (F.col("stop") >= F.col("start")) & (F.col("stop") - F.col("start") <= SAME)
    sound = still | (m.isNotNull() & ~F.col("_lost") & (m["longest"] <= k.max_gap + SAME))
    met = met.withColumns({"_still": still, "_fast": F.coalesce(fast & ~still, F.lit(False)), "ok": F.coalesce(sound & finite(F.col("yaw")), F.lit(False))})

    slow = met.where(~F.col("_fast"))
    c, s = F.cos("yaw"), F.sin("yaw")
    turn = lambda a: F.array(c * a[0] - s * a[1], s * a[0] + c * a[1], a[2])
    w, q = rot.parts(turn(rot.parts(m["w"], 3)), 3), rot.parts(turn(rot.parts(m["q"], 3)), 3)
    delta = F.array(m["f"] * v[0] + q[0], m["f"] * v[1] + q[1], m["fz"] * v[2] + q[2])
    change = F.array(m["e"] * v[0] + w[0] - v[0], m["e"] * v[1] + w[1] - v[1], m["ez"] * v[2] + w[2] - v[2])
    slow = slow.withColumns({"delta": F.when(F.col("_still"), F.expr(ZEROS)).otherwise(delta), "delta_vel": F.when(F.col("_still"), F.expr(ZEROS)).otherwise(change)})

    sped = met.where(F.col("_fast"))
    own = given.join(sped.select(F.col(by).alias("_by"), F.col("seq").alias("_seq")), given[by].eqNullSafe(F.col("_by")) & (F.col("seq") == F.col("_seq")), "left_semi")
    runs = own.groupBy(F.col(by).alias("_by"), F.col("seq").alias("_seq")).agg(ordered().alias("_p"))
    sped = sped.join(runs, sped[by].eqNullSafe(F.col("_by")) & (F.col("seq") == F.col("_seq"))).drop("_by", "_seq")
    sped = sped.withColumn("_end", F.aggregate("_p", start_state(F.col("velocity")), lambda st, x: carried(st, x["p"], F.col("yaw"), k))).drop("_p")
    sped = sped.withColumns({"delta": F.col("_end.pos"), "delta_vel": F.zip_with("_end.vel", "velocity", lambda a, b: a - b)}).drop("_end")

    every = slow.unionByName(sped).drop("_map", "_lost", "_still", "_fast")
    every = every.withColumns({c: F.when(F.col("ok"), F.col(c)) for c in ("delta", "delta_vel")})
    span = F.col("stop") - F.col("start")
    final = rot.length(rot.parts(rot.added(F.col("velocity"), F.col("delta_vel")), 3))
    mean = F.when(span > SAME, rot.length(rot.parts(F.col("delta"), 3)) / span).otherwise(F.when(F.col("ok"), 0.0))
    return every.withColumns({"mean_speed": mean, "final_speed": final})


def causal(points: DataFrame, states: DataFrame, limits: Limits | None = None, by: str = "vehicle_id", width: float = 60.0) -> DataFrame:
    """points with state (t, r, accel, bias) as it is known at t: the last state at or before t, held forward; null before the first.

    Past the vehicle's last state it is held for max_gap at most.
    """
    k = limits or Limits()
    near = asof.neighbours(points, states, STATE, by=by, width=width)
    hit = F.coalesce(F.abs(F.col("after.t") - F.col("t")) <= SAME, F.lit(False))
    chosen = near.withColumn("_s", F.when(hit, F.col("after")).when(F.col("after").isNotNull() | (F.col("t") - F.col("before.t") <= k.max_gap), F.col("before")))
    return chosen.withColumn("state", F.when(F.col("_s").isNotNull(), held(F.col("_s"), F.col("t"), k))).drop("before", "after", "_s")


def between(points: DataFrame, states: DataFrame, limits: Limits | None = None, by: str = "vehicle_id", width: float = 60.0) -> DataFrame:
    """points with state (t, r, accel, bias) from the states on both sides: samples and bias interpolated, the attitude turned on from the left state.

    Within the states' range only; a state at t is taken as it is.  The attitude is turned by the rate
    interpolated between both states' rates, as far as the accelerometer's correction at the left state says.
    """
    k = limits or Limits()
    near = asof.neighbours(points, states, STATE, by=by, width=width)
    w = asof.share(F.col("t"))
    lerp = lambda f: F.zip_with(f"before.{f}", f"after.{f}", lambda x, y: x * (1.0 - w) + y * w)
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    near = near.withColumn("_mid", F.when(both, F.struct(F.col("before.t").alias("t"), F.col("before.r").alias("r"), lerp("accel").alias("accel"), lerp("bias").alias("bias"), lerp("turn").alias("turn"), F.col("before.integral").alias("integral"), F.col("before.drift").alias("drift"))))
    hit = F.coalesce(F.abs(F.col("after.t") - F.col("t")) <= SAME, F.lit(False))
    own = F.struct(F.col("after.t").alias("t"), *[F.col(f"after.{f}").alias(f) for f in ("r", "accel", "bias")])
    return near.withColumn("state", F.when(hit, own).when(both, held(F.col("_mid"), F.col("t"), k))).drop("before", "after", "_mid")
