"""Accuracy of trajectories against a reference: overlap, errors, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.geo import sphere_error, sphere_inverse
from fathomline.operators.asof import interpolate


def overlap(*series: DataFrame, by: str = "vehicle_id", t: str = "t") -> DataFrame:
    """by, start (latest of first times) and stop (earliest of last times) where all series overlap."""
    out = None
    for s in series:
        ends = s.groupBy(by).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
        if out is None:
            out = ends.select(by, F.col("lo").alias("start"), F.col("hi").alias("stop"))
        else:
            out = out.join(ends, by).select(by, F.greatest("start", "lo").alias("start"), F.least("stop", "hi").alias("stop"))
    return out.where("start < stop")


def clip(series: DataFrame, interval: DataFrame, by: str = "vehicle_id", t: str = "t") -> DataFrame:
    """Rows within the interval, both ends included, with start and stop."""
    return series.join(interval, by).where(F.col(t).between(F.col("start"), F.col("stop")))


def errors(samples: DataFrame, refs: DataFrame, clip_refs: bool = True, by: str = "vehicle_id") -> DataFrame:
    """Samples in the overlap with east, north, up, horizontal and spatial error in metres and time since its start.

    clip_refs: references outside the overlap are dropped before interpolation, so samples beyond the
    remaining ones go too.
    """
    interval = overlap(samples, refs, by=by)
    inside = clip(samples.select(by, "t", "seq", "lon", "lat", "alt"), interval, by)
    known = clip(refs.select(by, "t", "seq", "lon", "lat", "alt"), interval, by) if clip_refs else refs
    met = interpolate(inside, known, ["lon", "lat", "alt"], by=by)
    east, north = sphere_error(F.col("lon"), F.col("lat"), F.col("ref_lon"), F.col("ref_lat"))
    return met.withColumns({"east": east, "north": north, "up": F.col("alt") - F.col("ref_alt"), "since": F.col("t") - F.col("start")}).withColumns(
        {"horizontal": F.hypot("east", "north"), "spatial": F.sqrt(F.col("east") ** 2 + F.col("north") ** 2 + F.col("up") ** 2)}
    )


def statistics(x: Column) -> list[Column]:
    """n, mean, rmse and largest magnitude, as aggregates."""
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.sqrt(F.avg(x * x)).alias("rmse"), F.max(F.abs(x)).alias("max_abs")]


def below_thresholds(df: DataFrame, x: str, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """One row a threshold: how many values are strictly below it, and their percentage."""
    wanted = sorted({float(v) for v in thresholds if v > 0})
    counts = df.groupBy(*(by or [])).agg(F.count(x).alias("n"), *[F.count_if(F.col(x) < v).alias(f"_{k}") for k, v in enumerate(wanted)])
    pairs = F.array(*[F.struct(F.lit(v).alias("threshold"), F.col(f"_{k}").alias("below")) for k, v in enumerate(wanted)])
    out = counts.select(*(by or []), "n", F.explode(pairs).alias("p")).select(*(by or []), "n", "p.threshold", "p.below")
    return out.withColumn("percent", F.try_divide(100.0 * F.col("below"), F.col("n")))


def alignment(vision_errors: DataFrame, seconds: float, by: str = "vehicle_id") -> DataFrame:
    """Mean east and north error in the first seconds (end excluded)."""
    return vision_errors.where((F.col("since") >= 0) & (F.col("since") < seconds)).groupBy(by).agg(
        F.avg("east").alias("east_offset"), F.avg("north").alias("north_offset"), F.count(F.lit(1)).alias("n")
    )


def aligned(series_errors: DataFrame, offsets: DataFrame, seconds: float, by: str = "vehicle_id") -> DataFrame:
    """Errors from `seconds` on, less the offset learned before."""
    late = series_errors.where(F.col("since") >= seconds).join(offsets.select(by, "east_offset", "north_offset"), by)
    return late.withColumns({"east": F.col("east") - F.col("east_offset"), "north": F.col("north") - F.col("north_offset")}).withColumn(
        "horizontal", F.hypot("east", "north")
    )


def series_errors(series: dict[str, DataFrame], refs: DataFrame, by: str = "vehicle_id") -> DataFrame:
    """series (its name), east, north and horizontal error of several series, all within the interval that they share with refs.

    The series are one table and meet the references in one join.
    """
    interval = overlap(*series.values(), refs, by=by)
    united = None
    for name, rows in series.items():
        named = rows.select(by, "t", "seq", "lon", "lat", F.lit(name).alias("series"))
        united = named if united is None else united.unionByName(named)
    met = interpolate(clip(united, interval, by), clip(refs.select(by, "t", "seq", "lon", "lat"), interval, by), ["lon", "lat"], by=by)
    east, north = sphere_error(F.col("lon"), F.col("lat"), F.col("ref_lon"), F.col("ref_lat"))
    return met.withColumns({"east": east, "north": north, "since": F.col("t") - F.col("start")}).withColumn("horizontal", F.hypot("east", "north"))


def corrected_path(path: DataFrame, vision: DataFrame, refs: DataFrame, seconds: float, by: str = "vehicle_id") -> DataFrame:
    """by, t, seq, lon and lat of path from `seconds` after the shared start on, less the mean error of vision before that.

    References outside the shared interval count, and the first and last hold beyond the ends.
    """
    interval = overlap(vision, path, refs, by=by)
    pick = lambda rows, name: rows.select(by, "t", "seq", "lon", "lat", F.lit(name).alias("series"))
    both = clip(pick(vision, "vision").unionByName(pick(path, "path")), interval, by)
    met = interpolate(both, refs, ["lon", "lat"], "clamped", by=by).withColumn("since", F.col("t") - F.col("start"))
    east, north = sphere_error(F.col("lon"), F.col("lat"), F.col("ref_lon"), F.col("ref_lat"))
    moved = met.withColumns({"east": east, "north": north})
    offsets = alignment(moved.where("series = 'vision'"), seconds, by)
    late = aligned(moved.where("series = 'path'"), offsets, seconds, by)
    lon, lat = sphere_inverse(F.col("ref_lon"), F.col("ref_lat"), F.col("east"), F.col("north"))
    return late.select(by, "t", "seq", lon.alias("lon"), lat.alias("lat"))


def verdict(sources: DataFrame) -> DataFrame:
    """One row: n_rows, updates, gate_failed, failed_percent (null without visual rows) and verdict; sources: source, n."""
    counted = lambda source: F.coalesce(F.sum(F.when(F.col("source") == source, F.col("n"))), F.lit(0))
    sums = sources.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), counted("visual_update").alias("updates"), counted("visual_reject_nis").alias("gate_failed"))
    percent = F.try_divide(100.0 * F.col("gate_failed"), F.col("updates") + F.col("gate_failed"))
    text = F.when(F.col("updates") > 0, "usable").when(F.col("gate_failed") > 0, "all_gates_failed").otherwise("no_visual_update")
    return sums.withColumns({"failed_percent": percent, "verdict": text})


def pairwise_errors(series: dict[str, DataFrame], refs: DataFrame, by: str = "vehicle_id") -> DataFrame:
    """errors of each series in the interval that it alone shares with refs, which are not clipped; series: its name."""
    out = None
    for name, rows in series.items():
        named = errors(rows, refs, False, by).select(by, "seq", "since", "east", "north", "up", "spatial", F.lit(name).alias("series"))
        out = named if out is None else out.unionByName(named)
    return out


def magnitudes(found: DataFrame, by: str = "series") -> DataFrame:
    """by, n, mean magnitudes of east, north and up, and the mean spatial error."""
    means = [F.avg(F.abs(F.col(c))).alias(f"mean_abs_{c}") for c in ("east", "north", "up")]
    return found.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *means, F.avg("spatial").alias("mean_total"))
