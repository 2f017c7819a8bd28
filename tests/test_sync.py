"""Prepared frames: batch against a plain loop, and streams against batch for several cuts into micro-batches."""

import math
import random

import pytest

from fathomline.operators import sync
from fathomline.streaming.sync import prepare_stream

FRAME = "vehicle_id string, t double, seq bigint"
FIX = FRAME + ", lon double, lat double, alt double"
IMU = FRAME + ", roll double, pitch double"
SHIFT, PATIENCE = 0.25, 6.0


def tables(seed=4):
    """Three vehicles: one with late starts and gaps, one without fixes, one with everything."""
    rng = random.Random(seed)
    frames, fixes, imu = [], [], []
    for v, (lo, hi, fix_lo, fix_hi) in {"a": (0, 40, 3, 35), "b": (0, 30, 99, 99), "c": (0, 40, 0, 40)}.items():
        frames += [(v, 1000.0 + rng.randrange(lo * 4, hi * 4) / 4, k) for k in range(40)]
        fixes += [(v, 1000.0 + t, t, rng.random(), rng.random(), rng.random()) for t in range(fix_lo, fix_hi) if v != "a" or not 12 <= t < 21]
        imu += [(v, 1000.5 + t / 2, t, rng.random(), rng.random()) for t in range(2 * lo + (8 if v == "c" else 0), 2 * hi) if v != "c" or not 30 <= t < 50]
    return frames, fixes, imu


def plain(frames, fixes, imu):
    def at(refs, t, width):
        later = sorted(r for r in refs if r[1] >= t)
        earlier = sorted(r for r in refs if r[1] < t)
        late = not later or later[0][1] - t > PATIENCE
        early = not earlier and not (later and later[0][1] == t)
        if late or early:
            return late, early, [None] * width
        if later[0][1] == t:
            return late, early, list(later[0][3:])
        one, other = earlier[-1], later[0]
        return late, early, [a + (t - one[1]) / (other[1] - one[1]) * (b - a) for a, b in zip(one[3:], other[3:], strict=True)]

    out = []
    for v, t, seq in frames:
        fix = at([r for r in fixes if r[0] == v], t, 3)
        own = at([r for r in imu if r[0] == v], t + SHIFT, 2)
        reasons = [(fix[0], sync.NO_FIX), (own[0], sync.NO_IMU), (fix[1], sync.EARLY_FIX), (own[1], sync.EARLY_IMU)]
        out.append((v, t, seq, *fix[2], *own[2], next((name for holds, name in reasons if holds), None)))
    return out


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or "", r[1], r[2] is not None, r[2] or 0)
    got, want = sorted(map(tuple, got), key=key), sorted(map(tuple, want), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and y is not None and math.isclose(x, y, abs_tol=1e-9)) for x, y in zip(a, b, strict=True)), (a, b)


def test_batch_is_the_plain_loop(spark):
    frames, fixes, imu = tables()
    want = plain(frames, fixes, imu)
    assert {r[-1] for r in want} == {None, sync.NO_FIX, sync.NO_IMU, sync.EARLY_FIX, sync.EARLY_IMU}
    odd_fixes = [("c", None, 1, 0.0, 0.0, 0.0), ("c", 1001.5, 1, math.nan, 0.0, 0.0), ("c", math.inf, 2, 0.0, 0.0, 0.0)]
    sides = [spark.createDataFrame(rows, schema) for rows, schema in ((frames + [("c", None, 1), (None, 1001.0, 7)], FRAME), (fixes + odd_fixes, FIX), (imu, IMU))]
    out = sync.prepare(*sides, shift=SHIFT, patience=PATIENCE, width=7.0)
    same(out.collect(), [*want, (None, 1001.0, 7, *[None] * 5, sync.NO_FIX)])
    assert sync.prepare(sides[0].where("false"), *sides[1:]).count() == 0
    assert {r["failure_reason"] for r in sync.prepare(sides[0], sides[1].where("false"), sides[2]).collect()} == {sync.NO_FIX}


@pytest.mark.parametrize("cut", [1, 3, 11])
def test_stream_is_the_batch(spark, tmp_path, cut):
    frames, fixes, imu = ([(None if cut == 3 and r[0] == "c" else r[0], *r[1:]) for r in rows] for rows in tables())  # null is a key
    frames += [("a", 1010.0, None)] * 2
    want = plain(frames, fixes, imu)
    rng, streams = random.Random(cut), []
    for name, rows, schema in (("frames", frames, FRAME), ("fixes", fixes, FIX), ("imu", imu, IMU)):
        # out of order by up to a second, a file a micro-batch, and at the end a vehicle of its own that pushes the watermark
        rows = sorted(rows, key=lambda r: r[1] + rng.random())
        end = [("end", 2000.0, 0, *[0.0] * (len(rows[0]) - 3))]
        edges = [round(k * len(rows) / cut) for k in range(cut + 1)]
        for k, part in enumerate([*[rows[a:b] for a, b in zip(edges, edges[1:], strict=False)], end, [(v, 3000.0, *r) for v, _, *r in end]]):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/part={k:03d}")
        streams.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = prepare_stream(*streams, delay="2 seconds", shift=SHIFT, patience=PATIENCE)
        query = out.writeStream.format("memory").queryName(f"prepared_{cut}").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(240)
    finally:
        spark.conf.unset(provider)
    same([r for r in spark.table(f"prepared_{cut}").collect() if r["vehicle_id"] != "end"], want)
