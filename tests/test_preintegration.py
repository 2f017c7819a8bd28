"""Preintegration, states as of a time, and the position at every fix, against plain loops."""

import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators import anchors, fix_rate, inertial
from fathomline.operators import preintegration as pre

STATES = "vehicle_id string, t double, seq bigint, r array<double>, accel array<double>, bias array<double>, turn array<double>, integral array<double>, drift array<double>"
GAP = 0.2


def flat(m):
    return [x for row in m for x in row]


def made_states(seed, vehicle, n, first=10.0):
    rng, t, out = random.Random(seed), first, []
    three = lambda s: [rng.uniform(-s, s) for _ in range(3)]
    turn = three(1.0)
    for k in range(n):
        r = inertial.rotation(tuple(x * 0.3 for x in turn))
        out.append((vehicle, t, k, flat(r), [x + y for x, y in zip(three(3.0), (0, 0, 9.8), strict=True)], three(0.2), three(0.5), three(0.02), three(0.05)))
        turn = [a + b for a, b in zip(turn, three(0.2), strict=True)]
        t += rng.choice([0.01, 0.02, 0.05]) if k % 97 != 96 else 0.7
    return out


def matrix(r):
    return tuple(tuple(r[3 * k : 3 * k + 3]) for k in range(3))


def held(s, t, limits):
    dt = t - s[1]
    if dt <= 1e-9:
        return (t, s[3], s[4], s[5])
    integral = [a + b * dt for a, b in zip(s[7], s[8], strict=True)]
    size = math.sqrt(sum(x * x for x in integral))
    if size > limits.integral_limit:
        integral = [x * limits.integral_limit / size for x in integral]
    w = tuple((a + b) * dt for a, b in zip(s[6], integral, strict=True))
    return (t, flat(inertial.product(matrix(s[3]), inertial.rotation(w))), s[4], s[5])


def causal(states, times, t, limits):
    k = bisect.bisect_right(times, t + 1e-9) - 1
    if k < 0 or (k == len(states) - 1 and t - times[k] > limits.max_gap):
        return None
    return held(states[k], t, limits)


def loop(states, start, stop, yaw, vel, limits):
    """One sample after the other: (delta, vel) or None."""
    if stop < start:
        return None
    pos, vel, times = [0.0] * 3, list(vel), [s[1] for s in states]
    if stop - start <= 1e-9:
        return pos, vel
    if bisect.bisect_right(times, start + 1e-9) == 0:
        return None
    now = held(states[bisect.bisect_right(times, start + 1e-9) - 1], start, limits)
    c, s = math.cos(yaw), math.sin(yaw)
    while now[0] < stop - 1e-9:
        k = bisect.bisect_right(times, now[0] + 1e-9)
        nxt = (times[k], *states[k][3:6]) if k < len(times) and times[k] <= stop + 1e-9 else held(states[k - 1], stop, limits)
        dt = nxt[0] - now[0]
        if dt > limits.max_gap + 1e-9:
            return None
        mid = inertial.orthonormal(matrix([(a + b) / 2 for a, b in zip(now[1], nxt[1], strict=True)]))
        f = [(a + b) / 2 - (p + q) / 2 for a, b, p, q in zip(now[2], nxt[2], now[3], nxt[3], strict=True)]
        u = [sum(m * x for m, x in zip(row, f, strict=True)) for row in mid]
        a = [c * u[0] - s * u[1], s * u[0] + c * u[1], u[2] - inertial.GRAVITY]
        pos = [p + v * dt + 0.5 * x * dt * dt for p, v, x in zip(pos, vel, a, strict=True)]
        vel = [(v + x * dt) * math.exp(-(limits.damping_z if k == 2 else limits.damping) * dt) for k, (v, x) in enumerate(zip(vel, a, strict=True))]
        speed = math.hypot(vel[0], vel[1])
        if speed > limits.top_speed:
            vel[:2] = [v * limits.top_speed / speed for v in vel[:2]]
        vel[2] = max(-limits.top_climb, min(limits.top_climb, vel[2]))
        now = nxt
    return pos, vel


def near(a, b):
    return len(a) == len(b) and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("top_speed", [1e6, 3.0])
def test_preintegration_is_the_loop(spark, top_speed):
    limits = pre.Limits(max_gap=GAP, top_speed=top_speed)
    rows = {v: made_states(k, v, 300) for k, v in enumerate(("a", "b"))}
    rng, requests = random.Random(5), []
    for v, own in rows.items():
        t0, t1 = own[0][1], own[-1][1]
        ends = [(rng.uniform(t0 - 0.2, t1 + 0.1), rng.uniform(0, 3)) for _ in range(60)]
        ends += [(own[5][1], own[9][1] - own[5][1]), (own[5][1], 0.001), (own[5][1] + 0.001, 0.002), (own[7][1], 0.0), (own[3][1], -0.5), (own[-1][1], 0.1), (t0 - 1, 0.5), (t0, t1 - t0)]
        requests += [(v, k, a, own[9][1] if k == 60 else a + d, rng.uniform(-3, 3), [rng.uniform(-2, 2) for _ in range(3)]) for k, (a, d) in enumerate(ends)]
    requests.append(("no states", 1, 0.0, 1.0, 0.0, [0.0, 0.0, 0.0]))
    states = spark.createDataFrame(rows["a"] + rows["b"], STATES)
    asked = spark.createDataFrame(requests, "vehicle_id string, seq bigint, start double, stop double, yaw double, velocity array<double>")
    got = {(r["vehicle_id"], r["seq"]): r for r in pre.preintegrate(asked, states, limits, width=0.5).collect()}
    assert len(got) == len(requests)
    done = 0
    for v, k, start, stop, yaw, vel in requests:
        want, r = loop(rows.get(v, []), start, stop, yaw, vel, limits), got[v, k]
        assert r["ok"] == (want is not None), (v, k)
        if want:
            done += 1
            assert near(r["delta"], want[0]) and near([a + b for a, b in zip(vel, r["delta_vel"], strict=True)], want[1]), (v, k)
            assert math.isclose(r["final_speed"], math.sqrt(sum(x * x for x in want[1])), rel_tol=1e-9)
    assert 40 < done < len(requests) - 10


def test_states_as_of_a_time(spark):
    own = made_states(3, "a", 60)
    times, limits = [s[1] for s in own], pre.Limits(max_gap=GAP)
    at = [9.0, own[0][1], own[4][1], own[4][1] + 0.004, (own[10][1] + own[11][1]) / 2, own[-1][1], own[-1][1] + 0.1, own[-1][1] + 0.5]
    points = spark.createDataFrame([("a", t, k) for k, t in enumerate(at)], "vehicle_id string, t double, seq bigint")
    states = spark.createDataFrame(own, STATES)
    for r in pre.causal(points, states, limits).collect():
        want = causal(own, times, r["t"], limits)
        assert (r["state"] is None) == (want is None), r["t"]
        assert want is None or (near(r["state"]["r"], want[1]) and near(r["state"]["accel"], want[2]))
    for r in pre.between(points, states, limits).collect():
        k = bisect.bisect_left(times, r["t"] - 1e-9)
        if not times[0] <= r["t"] <= times[-1] + 1e-9:
            assert r["state"] is None
        elif abs(times[k] - r["t"]) <= 1e-9:
            assert near(r["state"]["r"], own[k][3])
        else:
            a, b = own[k - 1], own[k]
            w = (r["t"] - a[1]) / (b[1] - a[1])
            lerp = lambda i, a=a, b=b, w=w: [x * (1 - w) + y * w for x, y in zip(a[i], b[i], strict=True)]
            want = held((*a[:4], lerp(4), lerp(5), lerp(6), *a[7:]), r["t"], limits)
            assert near(r["state"]["r"], want[1]) and near(r["state"]["accel"], lerp(4)) and near(r["state"]["bias"], lerp(5))


def shifted(lon, lat, alt, d):
    """A point moved on the ellipsoid."""
    a, b = 6378137.0, 6378137.0 * (1 - 1 / 298.257223563)
    e2, e2b = 1 - b * b / a / a, a * a / b / b - 1
    la, lo = math.radians(lat), math.radians(lon)
    n = a / math.sqrt(1 - e2 * math.sin(la) ** 2)
    x, y, z = (n + alt) * math.cos(la) * math.cos(lo), (n + alt) * math.cos(la) * math.sin(lo), (n * (1 - e2) + alt) * math.sin(la)
    axes = ((-math.sin(lo), math.cos(lo), 0), (-math.sin(la) * math.cos(lo), -math.sin(la) * math.sin(lo), math.cos(la)), (math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)))
    x, y, z = (c + sum(axes[i][k] * d[i] for i in range(3)) for k, c in enumerate((x, y, z)))
    p = math.hypot(x, y)
    th = math.atan2(z * a, p * b)
    return math.degrees(math.atan2(y, x)), math.degrees(math.atan2(z + e2b * b * math.sin(th) ** 3, p - e2 * a * math.cos(th) ** 3)), alt + d[2]


def test_fix_positions(spark):
    limits, gates = pre.Limits(max_gap=GAP), anchors.Gates(max_age=1.5, innovation=80.0)
    own = made_states(8, "a", 400)
    times = [s[1] for s in own]
    rng = random.Random(2)
    fixes = [("a", 9.5 + 0.11 * k, k) for k in range(int((times[-1] - 9.3) / 0.11))] + [("no imu", 10.0 + k, 1000 + k) for k in range(3)]
    given = [("a", 9.6 + 0.83 * k, k, 109.0 + 1e-5 * k, 34.0, 400.0, [rng.uniform(-3, 3) for _ in range(3)] if k % 3 else None, None if k % 7 == 6 else rng.uniform(0, 6), 50, 0.9, 1.0) for k in range(20)]
    given.append(("no imu", 10.0, 100, 109.0, 34.0, 400.0, None, 1.0, 50, 0.9, 1.0))
    rows = spark.createDataFrame(given, "vehicle_id string, t double, seq bigint, lon double, lat double, alt double, vel array<double>, heading double, used int, inlier_ratio double, reproj double")
    got = {r["seq"]: r for r in fix_rate.positions(spark.createDataFrame(fixes, "vehicle_id string, t double, seq bigint"), rows, spark.createDataFrame(own, STATES), gates, limits, width=2.0).collect()}
    assert len(got) == len(fixes)
    seen, active, since, place, vel, reason = set(), None, 0.0, None, None, None
    for _, t, seq in fixes[:-3]:
        if active and t - active[1] > 1.5:
            active, reason = None, "visual_anchor_expired"
        for a in given[:-1]:
            if a[1] <= t and a[2] not in seen:
                seen.add(a[2])
                if t - a[1] <= 1.5:
                    active, since, place, vel, reason = a, a[1], a[3:6], a[6] or [0.0] * 3, None
        r = got[seq]
        assert r["anchor_seq"] == (active[2] if active else None), seq
        if not active:
            assert r["lon"] is None and r["failure_reason"] == (reason or "no_visual_anchor"), seq
            continue
        start = max(since, times[0])
        if t > start + 1e-9:
            rel = causal(own, times, active[1], limits) or (0, own[0][3])
            yaw = None if active[7] is None else math.atan2(rel[1][0], rel[1][3]) - active[7]
            moved = None if yaw is None else loop(own, start, t, yaw, vel, limits)
            if moved is None:
                assert r["lon"] is None and r["failure_reason"] == "imu_preintegration_failed", seq
                active, reason = None, "imu_preintegration_failed"
                continue
            place, vel = shifted(*place, moved[0]), moved[1]
            assert r["heading_source"] == "anchor+imu_delta"
        else:
            assert r["heading_source"] == "last_valid"
        since = t
        assert near((r["lon"], r["lat"], r["alt"]), place) and r["failure_reason"] is None, seq
        assert math.isclose(r["speed"], math.sqrt(sum(v * v for v in vel)), rel_tol=1e-9, abs_tol=1e-12)
    kinds = {r["failure_reason"] for r in got.values()}
    assert kinds >= {None, "imu_preintegration_failed", "no_visual_anchor"} and sum(r["lon"] is not None for r in got.values()) > 40
    assert {got[k]["failure_reason"] for k in (1000,)} == {None} and got[1001]["failure_reason"] == "imu_preintegration_failed"


def test_anchors_of_records(spark):
    schema = "vehicle_id string, t double, seq bigint, localized boolean, lon double, lat double, alt double, fused_lon double, fused_lat double, fused_alt double, fused_vel array<double>, yaw_deg double, used int, inliers int, reproj double"
    nan = math.nan
    rows = [
        ("a", 1.0, 1, True, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, [1.0, 2.0, 3.0], -90.0, 10, 5, 1.0),
        ("a", 2.0, 2, True, nan, 2.0, 3.0, 4.0, 5.0, 6.0, [1.0, nan, 3.0], None, 0, 0, None),
        ("a", 3.0, 3, True, 1.0, 2.0, 3.0, None, 5.0, 6.0, [1.0, 2.0, 3.0], nan, 10, 5, 1.0),
        ("a", 4.0, 4, False, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, None, 0.0, 10, 5, 1.0),
        ("a", None, 5, True, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, None, 0.0, 10, 5, 1.0),
        ("a", 6.0, 6, None, nan, None, 3.0, nan, 5.0, 6.0, None, 0.0, 10, 5, 1.0),
    ]
    headings = spark.createDataFrame([("a", 1.5, 1, 0.5)], "vehicle_id string, t double, seq bigint, heading double")
    got = {r["seq"]: r for r in fix_rate.anchors_of(spark.createDataFrame(rows, schema), headings).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1]["lon"], got[1]["vel"], got[1]["inlier_ratio"]) == (1.0, [1.0, 2.0, 3.0], 0.5) and math.isclose(got[1]["heading"], 1.5 * math.pi)
    assert (got[2]["lon"], got[2]["vel"], got[2]["heading"], got[2]["inlier_ratio"]) == (4.0, [0.0, 0.0, 0.0], 0.5, None)
    assert (got[3]["lon"], got[3]["vel"], got[3]["heading"]) == (1.0, [0.0, 0.0, 0.0], 0.5)


def test_states_of_samples_carry_on(spark):
    rng = random.Random(1)
    rows = [("a", 1.0 + 0.01 * k, k, *(rng.uniform(-0.2, 0.2) for _ in range(3)), rng.uniform(-0.3, 0.3), 0.1, -9.8) for k in range(60)]
    imu = spark.createDataFrame(rows, "vehicle_id string, t double, seq bigint, gx double, gy double, gz double, ax double, ay double, az double")
    got = inertial.states(imu).orderBy("t").collect()
    heads = inertial.attitudes(imu).orderBy("t").collect()
    assert len(got) == len(heads) == 41 and all(math.isclose(math.atan2(s["r"][0], s["r"][3]), h["heading"]) for s, h in zip(got, heads, strict=True))
    moved = pre.preintegrate(spark.createDataFrame([("a", 1, 1.3, 1.5, 0.0, [0.0, 0.0, 0.0])], "vehicle_id string, seq bigint, start double, stop double, yaw double, velocity array<double>"), inertial.states(imu))
    assert moved.select(F.col("ok")).first()["ok"]
