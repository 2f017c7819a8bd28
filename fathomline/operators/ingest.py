"""What a run takes in: valid fixes, numbered and gated images, trimmed histories, frames left at the end, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import geo
from fathomline.operators import asof


def valid_fixes(fixes: DataFrame) -> DataFrame:
    """Fixes with finite coordinates and a positive time; order and repetitions are left as they are."""
    return fixes.where(geo.finite(F.col("lon"), F.col("lat"), F.col("alt")) & (F.col("t") > 0))


def numbered(rows: DataFrame, by: str = "vehicle_id", t: str = "t", tie: str = "seq", width: float = 86400.0) -> DataFrame:
    """rows with index, their running count from 1 by key in the order of t and tie.

    Rows are counted in buckets of `width` seconds, and buckets by their counts, so no key is one task.
    """
    placed = rows.withColumn("_b", F.floor(F.col(t) / width))
    sizes = placed.groupBy(F.col(by).alias("_by"), F.col("_b").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_by", "_at", before.alias("_before"))
    local = placed.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_b").orderBy(t, tie)))
    met = local.join(offsets, local[by].eqNullSafe(offsets["_by"]) & local["_b"].eqNullSafe(offsets["_at"]))
    return met.select(*rows.columns, (F.col("_r") + F.col("_before")).alias("index"))


def taken_images(images: DataFrame, gate: DataFrame, start: int = 0, end: int = 0, by: str = "vehicle_id") -> DataFrame:
    """Images with their index that a run works on.

    Images with a positive time are counted; those from start to end (0: no bound) count while the
    gate (by, t, is_open) was last seen open.
    """
    counted = numbered(images.where(F.col("t") > 0), by)
    wanted = counted.where((F.col("index") >= max(start, 1)) & (F.lit(end <= 0) | (F.col("index") <= end)))
    seen = asof.latest(wanted, gate, ["is_open"], by=by)
    return seen.where(F.coalesce("ref_is_open", F.lit(False))).select(*counted.columns)


def trimmed(rows: DataFrame, keep: float, by: str = "vehicle_id", t: str = "t", tie: str = "seq") -> DataFrame:
    """The rows of the last `keep` seconds of each key and the one before them, so two of a key at least if it has two."""
    newest = rows.groupBy(F.col(by).alias("_by")).agg((F.max(t) - keep).alias("_from"))
    known = rows.join(newest, F.col(by).eqNullSafe(F.col("_by")))
    place = F.struct(t, tie)
    last = known.groupBy(F.col(by).alias("_key")).agg(F.max(F.when(F.col(t) < F.col("_from"), place)).alias("_last"))
    met = known.join(last, F.col(by).eqNullSafe(F.col("_key")))
    return met.where((F.col(t) >= F.col("_from")) | place.eqNullSafe(F.col("_last"))).select(*rows.columns)


def left_waiting(frames: DataFrame, fixes: DataFrame, imu: DataFrame, by: str = "vehicle_id") -> DataFrame:
    """Frames that no later fix or inertial sample ever followed, with the reason for dropping them at the end."""
    ends = lambda rows, name: rows.groupBy(F.col(by).alias(f"_{name}")).agg(F.min("t").alias(f"_{name}_lo"), F.max("t").alias(f"_{name}_hi"))
    met = frames.join(ends(fixes, "fix"), F.col(by).eqNullSafe(F.col("_fix")), "left").join(ends(imu, "imu"), F.col(by).eqNullSafe(F.col("_imu")), "left")
    no_fix = F.col("_fix_hi").isNull() | (F.col("t") > F.col("_fix_hi"))
    no_imu = F.col("_imu_hi").isNull() | (F.col("t") > F.col("_imu_hi"))
    known = ~no_fix & (F.col("t") >= F.col("_fix_lo"))
    reason = F.when(known, "waiting_for_future_imu_on_shutdown").otherwise("waiting_for_future_gps_on_shutdown")
    return met.where(no_fix | no_imu).select(*frames.columns, reason.alias("failure_reason"))


def reference_frame(fixes: DataFrame, by: str = "vehicle_id", tie: str = "seq") -> DataFrame:
    """by, t, lon, lat, alt of each key's first finite fix, which local coordinates start from."""
    first = valid_fixes(fixes).groupBy(by).agg(F.min(F.struct("t", tie, "lon", "lat", "alt")).alias("_f"))
    return first.select(by, "_f.t", "_f.lon", "_f.lat", "_f.alt")


def replay_latency(rows: DataFrame, wall: Column, by: str = "vehicle_id", tie: str = "seq") -> DataFrame:
    """rows with replay_ms: how much later than the first row's a row's wall time is than its stamp says."""
    timed = rows.withColumn("_wall", wall)
    first = timed.groupBy(F.col(by).alias("_by")).agg(F.min(F.struct("t", tie, "_wall")).alias("_first"))
    met = timed.join(first, F.col(by).eqNullSafe(F.col("_by")))
    late = ((F.col("_wall") - F.col("_first._wall")) - (F.col("t") - F.col("_first.t"))) * 1000.0
    return met.select(*rows.columns, late.alias("replay_ms"))


def counters(rows: DataFrame, kinds: dict[str, str], kind: str = "kind") -> DataFrame:
    """One row: <name>_count of the rows of each kind."""
    return rows.agg(*[F.count_if(F.col(kind) == value).alias(f"{name}_count") for name, value in kinds.items()])
