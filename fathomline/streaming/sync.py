"""`operators.sync.prepare` over three streams: frames, fixes and inertial rows.

Each stream has a watermark on its own event time, and the query's is the least of the three: that is the barrier at which frames
wait.  Rows are kept in list state by kind until a timer of event time finds that the watermark has passed the references which
decide a frame, or its patience; what is decided never depends on how rows were cut into micro-batches or in which order they came
within the watermark's delay.  Later rows are dropped, as by any operator with a watermark.  State of a key: the rows between the
watermark and the newest row, frames that wait (patience seconds at most), and the references from the last one before the
oldest of these on.  Readers bound their rate with their own options (maxFilesPerTrigger, maxOffsetsPerTrigger).

Transforming with state needs the RocksDB state store provider, which is the deployment's setting
(spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fathomline.operators.sync import EARLY_FIX, EARLY_IMU, FIX, FOREVER, IMU, NO_FIX, NO_IMU, sound

KINDS = {"frame": (), "fix": FIX, "imu": IMU}
OUT = "t double, seq bigint, " + ", ".join(f"{c} double" for c in (*FIX, *IMU)) + ", failure_reason string"

Row = tuple[float, int | None]  # t, seq and the fields of its kind


def _order(row: Row) -> tuple:
    return row[0], row[1] is not None, row[1] or 0


def _around(refs: list[Row], times: list[float], t: float, passed: float, patience: float) -> tuple[bool, bool, tuple | None] | None:
    """late, early and the fields at t, or None if rows to come may change them; passed: no row up to this time can come any more."""
    at = bisect_left(times, t)
    if at == len(refs) or times[at] > passed:
        return (True, at == 0, None) if t + patience <= passed else None
    one, other = refs[at - 1] if at else None, refs[at]
    if other[0] - t > patience:
        return True, at == 0, None
    if other[0] == t:
        return False, False, other[2:]
    if one is None:
        return False, True, None
    share = (t - one[0]) / (other[0] - one[0])
    return False, False, tuple(a + share * (b - a) for a, b in zip(one[2:], other[2:], strict=True))


def settle(frames: list[Row], fixes: list[Row], imu: list[Row], passed: float, shift: float, patience: float) -> tuple[list[tuple], list[Row]]:
    """Rows of the frames that are decided, and the frames that wait; references sorted."""
    rows, waiting = [], []
    fix_times, imu_times = [r[0] for r in fixes], [r[0] for r in imu]
    for frame in frames:
        fix = _around(fixes, fix_times, frame[0], passed, patience)
        own = _around(imu, imu_times, frame[0] + shift, passed, patience)
        if frame[0] > passed or fix is None or own is None:
            waiting.append(frame)
            continue
        told = ((fix[0], NO_FIX), (own[0], NO_IMU), (fix[1], EARLY_FIX), (own[1], EARLY_IMU))
        rows.append((*frame, *(fix[2] or [None] * len(FIX)), *(own[2] or [None] * len(IMU)), next((name for holds, name in told if holds), None)))
    return rows, waiting


def needed(refs: list[Row], since: float) -> list[Row]:
    """References from the last one before a time on."""
    return refs[max(0, bisect_left(refs, since, key=lambda r: r[0]) - 1) :]


class Preparer(StatefulProcessor):
    def __init__(self, names: list[str], shift: float, patience: float):
        self.names, self.shift, self.patience = names, shift, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lists = {kind: handle.getListState(kind, "t double, seq bigint" + "".join(f", {c} double" for c in fields)) for kind, fields in KINDS.items()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for kind, own in frame.groupby("kind"):
                fields = own[["t", "seq", *[f"x{k}" for k in range(len(KINDS[kind]))]]]
                self.lists[kind].appendList([(float(t), None if pd.isna(seq) else int(seq), *map(float, x)) for t, seq, *x in fields.itertuples(index=False, name=None)])
        self._wake(timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000.0
        frames, fixes, imu = (sorted(map(tuple, self.lists[kind].get()), key=_order) for kind in KINDS)
        rows, waiting = settle(frames, fixes, imu, passed, self.shift, self.patience)
        oldest = min([passed, *[f[0] for f in waiting]])
        kept = {"frame": waiting, "fix": needed(fixes, oldest), "imu": needed(imu, oldest + min(0.0, self.shift))}
        for kind, before in zip(KINDS, (frames, fixes, imu), strict=True):
            if len(kept[kind]) < len(before):
                self.lists[kind].put(kept[kind]) if kept[kind] else self.lists[kind].clear()
        if waiting or any(r and r[-1][0] > passed for r in (fixes, imu)):
            self._wake(timerValues)
        if rows:
            yield pd.DataFrame([(key[0], *row) for row in rows], columns=self.names)

    def _wake(self, timerValues) -> None:
        """At the next advance of the watermark."""
        self.handle.registerTimer(max(0, timerValues.getCurrentWatermarkInMs()) + 1)

    def close(self) -> None:
        pass


def prepare_stream(
    frames: DataFrame, fixes: DataFrame, imu: DataFrame, delay: str = "2 seconds", shift: float = 0.0, patience: float = FOREVER, by: str = "vehicle_id"
) -> DataFrame:
    """The rows of `operators.sync.prepare` over streams of the same columns; delay: how much out of order a stream's rows may be."""

    def rows(df: DataFrame, kind: str) -> DataFrame:
        own = dict(enumerate(KINDS[kind]))
        fields = [F.col(own[k]).cast("double").alias(f"x{k}") if k in own else F.lit(None).cast("double").alias(f"x{k}") for k in range(max(map(len, KINDS.values())))]
        there = sound(df, KINDS[kind])
        timed = there.select(by, F.timestamp_micros((F.col("t") * 1e6).cast("bigint")).alias("at"), F.col("t").cast("double"), F.col("seq").cast("bigint"), F.lit(kind).alias("kind"), *fields)
        return timed.withWatermark("at", delay)

    every = rows(frames, "frame").unionByName(rows(fixes, "fix")).unionByName(rows(imu, "imu"))
    names = [by, *[part.split()[0] for part in OUT.split(", ")]]
    kind = every.schema[by].dataType.simpleString()
    return every.groupBy(by).transformWithStateInPandas(Preparer(names, shift, patience), f"{by} {kind}, {OUT}", "append", "EventTime")
