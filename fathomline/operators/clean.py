"""Track cleaning: jump filter, gap fill, throttle, opening gate, gaps into sessions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.geo import SEMI_MAJOR
from fathomline.plans.fold import fold_sorted


def _sphere_metres(lon: float, lat: float, lon0: float, lat0: float) -> float:
    mean = math.radians((lat + lat0) / 2.0)
    return math.hypot(math.radians(lon - lon0) * SEMI_MAJOR * math.cos(mean), math.radians(lat - lat0) * SEMI_MAJOR)


def mark_jumps(track: DataFrame, most: float, by: str = "vehicle_id") -> DataFrame:
    """by, t, seq, lon, lat, alt and accepted: whether the row is within most metres of the last accepted row.

    A row whose position isn't finite is not accepted, and no other row is measured against it.
    """

    def step(last, row):
        _, t, seq, lon, lat, alt = row
        there = lon is not None and lat is not None and math.isfinite(lon) and math.isfinite(lat)
        ok = there and (last is None or _sphere_metres(lon, lat, *last) <= most)
        return ((lon, lat) if ok else last), [(*row, ok)]

    kind = track.schema[by].dataType.simpleString()
    seq = track.schema["seq"].dataType.simpleString()
    return fold_sorted(
        track.select(by, "t", "seq", "lon", "lat", "alt"), by, ["t", "seq"], step, f"{by} {kind},t double,seq {seq},lon double,lat double,alt double,accepted boolean"
    )


def fill_rejected(marked: DataFrame, by: str = "vehicle_id") -> DataFrame:
    """Rejected positions replaced: by interpolation between accepted neighbours, or a copy of the only one."""
    point = F.when(F.col("accepted"), F.struct("t", "lon", "lat", "alt"))
    before = Window.partitionBy(by).orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(by).orderBy(F.desc("t"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    near = marked.withColumn("_a", F.last(point, True).over(before)).withColumn("_b", F.last(point, True).over(after))
    part = F.when(F.col("_b.t") > F.col("_a.t"), (F.col("t") - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))).otherwise(0.0)
    new = {
        f: F.when(F.col("accepted"), F.col(f)).otherwise(
            F.coalesce(F.col(f"_a.{f}") + part * (F.col(f"_b.{f}") - F.col(f"_a.{f}")), F.col(f"_a.{f}"), F.col(f"_b.{f}"), F.col(f))
        )
        for f in ("lon", "lat", "alt")
    }
    return near.withColumns(new).drop("_a", "_b")


def throttle(rows: DataFrame, least: float, by: str = "vehicle_id") -> DataFrame:
    """by, t, seq of the rows at least `least` seconds after the last one let through; rows without a finite t pass."""

    def step(last, row):
        t = row[1]
        if t is None or not math.isfinite(t):
            return last, [row]
        if last is None or t - last + 1e-9 >= least:
            return t, [row]
        return last, []

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (by, "seq")}
    return fold_sorted(rows.select(by, "t", "seq"), by, ["t", "seq"], step, f"{by} {kinds[by]},t double,seq {kinds['seq']}")


def _mean(x: Column) -> Column:
    """Mean over a group of the rows' sum rounded once, so that it doesn't depend on their order; a plain average for values of 2**30 and more or not finite.

    A double is dealt into whole numbers of 2**-20 and of 2**-60, which are added without error.
    """
    high = F.floor(x * 2.0**20)
    low = ((x * 2.0**20 - high) * 2.0**40).cast("long")
    small = F.abs(x) < 2.0**30
    total = F.sum(F.when(small, high).cast("decimal(16,0)")) * F.lit(2**40) + F.sum(F.when(small, low).cast("decimal(14,0)"))
    return F.when(F.max(F.abs(x)) < 2.0**30, total.cast("double") * 2.0**-60 / F.count(x)).otherwise(F.avg(x))


def open_gate(fixes: DataFrame, rise: float, seconds: float = 5.0, by: str = "vehicle_id") -> DataFrame:
    """fixes with baseline (mean altitude of the first seconds), is_open and edge ("open", "close" or null).

    Altitudes often lie exactly rise above a baseline, so the baseline's sum is rounded once and a row's answer doesn't depend on how rows were split.
    """
    key = F.col(by).alias("_by")
    first = fixes.groupBy(key).agg(F.min("t").alias("_t0"))
    early = F.col("t") - F.col("_t0") <= seconds + 1e-6
    same = F.col(by).eqNullSafe(F.col("_by"))
    known = fixes.join(first, same).drop("_by")
    base = known.where(early).groupBy(key).agg(_mean(F.col("alt")).alias("baseline"))
    gated = known.join(base, same, "left").drop("_by").withColumn("is_open", ~early & (F.col("alt") - F.col("baseline") > rise))
    was = F.coalesce(F.lag("is_open").over(Window.partitionBy(by).orderBy("t", "seq")), F.lit(False))
    edge = F.when(F.col("is_open") & ~was, "open").when(~F.col("is_open") & was, "close")
    return gated.withColumn("edge", edge).drop("_t0")


def sessions(rows: DataFrame, gap: float, by: str = "vehicle_id") -> DataFrame:
    """by, session, start, stop, n: runs of rows without a gap of more than `gap` seconds."""
    own = Window.partitionBy(by).orderBy("t", "seq")
    marked = rows.withColumn("_new", (F.col("t") - F.lag("t").over(own) > gap).cast("int"))
    numbered = marked.withColumn("session", F.coalesce(F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return numbered.groupBy(by, "session").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.count(F.lit(1)).alias("n"))
