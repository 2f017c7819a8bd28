"""As-of neighbours and interpolation between time series that share a key.

For every sample the nearest reference before it and the nearest at or after it are found.  A key may
hold a large part of all rows, so time is cut into buckets: the rows of a (key, bucket) are scanned in
order in one task, and what lies in earlier or later buckets comes from a scan over the buckets' first
and last references, one row a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A reference this near to a sample in time is the sample's own.
SAME = 1e-9


def neighbours(samples: DataFrame, refs: DataFrame, fields: list[str], by: str = "vehicle_id", t: str = "t", width: float = 86400.0) -> DataFrame:
    """samples with structs before (last reference with a smaller t) and after (first with the same or a larger one), each of t and fields.

    References with equal t are taken in the order of seq if they have it.  width: seconds of a bucket.
    """
    tie = F.col("seq") if "seq" in refs.columns else F.lit(0)
    ref = F.struct(F.col(t).alias("t"), tie.alias("seq"), *[F.col(f) for f in fields])
    bucket = F.floor(F.col(t) / width)
    left = samples.select(F.col(by).alias("_by"), F.col(t).alias("_t"), bucket.alias("_b"), F.struct(*samples.columns).alias("_row"), F.lit(None).cast(refs.select(ref.alias("r")).schema["r"].dataType).alias("_ref"))
    right = refs.where(F.col(t).isNotNull()).select(F.col(by).alias("_by"), F.col(t).alias("_t"), bucket.alias("_b"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), ref.alias("_ref"))
    both = left.unionByName(right)

    rank = F.when(F.col("_ref").isNull(), 0).otherwise(1)  # a sample comes before references of its time
    forward = Window.partitionBy("_by", "_b").orderBy("_t", rank, "_ref.seq").rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy("_by", "_b").orderBy(F.desc("_t"), rank.desc(), F.desc("_ref.seq")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("before", F.last("_ref", True).over(forward)).withColumn("after", F.last("_ref", True).over(backward))

    ends = both.groupBy("_by", "_b").agg(F.max("_ref").alias("last"), F.min("_ref").alias("first"))
    earlier = Window.partitionBy("_by").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("_by").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_by", "_b", F.last("last", True).over(earlier).alias("_prior"), F.last("first", True).over(later).alias("_next"))

    found = near.where(F.col("_row").isNotNull()).join(ends, (near["_by"].eqNullSafe(ends["_by"])) & (near["_b"].eqNullSafe(ends["_b"])))
    return found.select("_row.*", F.coalesce("before", "_prior").alias("before"), F.coalesce("after", "_next").alias("after"))


def share(t: Column) -> Column:
    """How far t is on the way from before to after."""
    return (t - F.col("before.t")) / (F.col("after.t") - F.col("before.t"))


def _between(field: str, t: Column, lerp: Callable[[Column, Column, Column], Column] | None) -> Column:
    one, other = F.col(f"before.{field}"), F.col(f"after.{field}")
    return lerp(one, other, share(t)) if lerp else one + share(t) * (other - one)


def interpolate(
    samples: DataFrame, refs: DataFrame, fields: list[str], mode: str = "inner", t: str = "t", prefix: str = "ref_", lerp: dict | None = None, **keys
) -> DataFrame:
    """samples with prefixed fields of refs interpolated at t.

    mode "closed": within the references' range, null outside, an end reference counts as inside;
    "inner": as evaluation wants it: rows before the first or after the last reference, or on the first
    only by coincidence within SAME, are dropped; "clamped": the end references are held.
    lerp: own interpolation of a field (for angles).
    """
    near = neighbours(samples, refs, fields, t=t, **keys)
    at = F.col(t)
    hit = F.col("after").isNotNull() & (F.abs(F.col("after.t") - at) <= SAME)
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    out = {}
    for f in fields:
        value = F.when(hit, F.col(f"after.{f}")).when(both, _between(f, at, (lerp or {}).get(f)))
        if mode == "clamped":
            value = F.coalesce(value, F.when(F.col("after").isNull(), F.col(f"before.{f}")).otherwise(F.col(f"after.{f}")))
        out[f"{prefix}{f}"] = value
    if mode == "inner":
        near = near.where(hit | both)
    elif mode not in {"closed", "clamped"}:
        raise ValueError(f"unknown mode {mode!r}")
    return near.withColumns(out).drop("before", "after")


def latest(samples: DataFrame, refs: DataFrame, fields: list[str], tolerance: float | None = None, t: str = "t", prefix: str = "ref_", **keys) -> DataFrame:
    """samples with the fields and t of the last reference at or before t, null if none is within tolerance (zero-order hold)."""
    near = neighbours(samples, refs, fields, t=t, **keys)
    at = F.col(t)
    on = F.col("after").isNotNull() & (F.col("after.t") <= at)
    chosen = F.when(on, F.col("after")).otherwise(F.col("before"))
    near = near.withColumn("_c", chosen)
    ok = F.col("_c").isNotNull() & (F.lit(True) if tolerance is None else at - F.col("_c.t") <= tolerance)
    return near.withColumns({f"{prefix}{f}": F.when(ok, F.col(f"_c.{f}")) for f in ["t", *fields]}).drop("before", "after", "_c")


def crop_centre(frames: DataFrame, fused: DataFrame, refs: DataFrame, fresh: float, held: float, by: str = "vehicle_id") -> DataFrame:
    """frames with lon, lat and centre: "recent" or "held" (last fused position, at most fresh or held seconds old), "reference" (interpolated), or null."""
    last = latest(frames, fused, ["lon", "lat"], held, prefix="fused_", by=by)
    met = interpolate(last, refs, ["lon", "lat"], "closed", by=by)
    age = F.col("t") - F.col("fused_t")
    centre = F.when(age <= fresh, "recent").when(age <= held, "held").when(F.col("ref_lon").isNotNull(), "reference")
    return met.withColumns({"centre": centre, "lon": F.coalesce("fused_lon", "ref_lon"), "lat": F.coalesce("fused_lat", "ref_lat")})
