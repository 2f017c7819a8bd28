"""Per-frame statistics of matched points: spread, terrain, residuals and robust covariance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import geo
from fathomline.functions import rotations as rot


def floor_quantile(values: Column, q: float) -> Column:
    """Element floor(q (n - 1)) of the sorted array: no interpolation."""
    return F.get(F.array_sort(values), F.floor(F.lit(q) * (F.size(values) - 1)).cast("int"))


def terrain(points: DataFrame, by: str = "frame_id", alt: str = "alt") -> DataFrame:
    """by, n, relief, population deviation and median of the finite altitudes."""
    a = F.col(alt)
    return points.where(geo.finite(a)).groupBy(by).agg(
        F.count(a).alias("n"), (F.max(a) - F.min(a)).alias("relief"), F.stddev_pop(a).alias("std"), F.median(a).alias("median")
    )


def quantiles(points: DataFrame, value: str, q: float, by: str = "frame_id") -> DataFrame:
    """by, n and quantile: by rank, so a frame of any size is sorted out of memory if need be."""
    own = Window.partitionBy(by)
    ranked = points.where(geo.finite(F.col(value))).select(by, value, F.row_number().over(own.orderBy(value)).alias("_r"), F.count(F.lit(1)).over(own).alias("n"))
    return ranked.where(F.col("_r") == F.floor(F.lit(q) * (F.col("n") - 1)) + 1).select(by, "n", F.col(value).alias("quantile"))


def spread(points: DataFrame, x: str, y: str, area: float | None = None, by: str = "frame_id") -> DataFrame:
    """by, n and the area of the bounding box (its share of `area` if given); null for fewer than two points."""
    box = (F.max(x) - F.min(x)) * (F.max(y) - F.min(y))
    return points.groupBy(by).agg(F.count(F.lit(1)).alias("n"), (box / area if area else box).alias("s")).select(by, "n", F.when(F.col("n") >= 2, F.col("s")).alias("spread"))


def depth_spread(points: DataFrame, distance: str, by: str = "frame_id") -> DataFrame:
    return points.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(distance).alias("depth_spread"))


def reprojection(points: DataFrame, u: str, v: str, by: str = "frame_id") -> DataFrame:
    return points.groupBy(by).agg(F.avg(F.hypot(u, v)).alias("mean_error"))


def reference_point(points: DataFrame, x: str, y: str, score: str, by: str = "frame_id") -> DataFrame:
    """Centre weighted by score, of 0.001 at least."""
    w = F.greatest(F.col(score), F.lit(1e-3))
    return points.groupBy(by).agg((F.sum(w * F.col(x)) / F.sum(w)).alias("x"), (F.sum(w * F.col(y)) / F.sum(w)).alias("y"))


def covariance_of(points: Column, u: str, v: str, w: str = "w", q: float = 0.9) -> Column:
    """Struct of n, kept, var_u, var_v, cov_uv and rmse of the residuals (fields u and v, weight w) of an array of points; n is 0 where none counts.

    Residuals with a finite value and positive weight count; those longer than the floor quantile q of
    all lengths are clipped unless fewer than two would remain.  The rest is centred on its medians; the
    covariance is weighted, and so is the rmse, which is not centred.
    """

    def sized(p: Column) -> Column:
        use = geo.finite(p[u], p[v], p[w]) & (p[w] > 0)
        return F.when(use, F.struct(F.hypot(p[u], p[v]).alias("len"), p[u].alias("u"), p[v].alias("v"), p[w].alias("w")))

    def clipped(all_: Column) -> Column:
        limit = F.get(all_, F.floor(F.lit(q) * (F.size(all_) - 1)).cast("int"))["len"]
        return rot.let(F.struct(all_.alias("all"), rot.let(limit, lambda top: F.filter(all_, lambda p: p["len"] <= top + 1e-12)).alias("near")), kept)

    def kept(s: Column) -> Column:
        rows = F.when(F.size(s["near"]) < 2, s["all"]).otherwise(s["near"])
        return F.struct(F.size(s["all"]).cast("long").alias("n"), rows.alias("rows"))

    def centred(s: Column) -> Column:
        return F.struct(s["n"].alias("n"), s["rows"].alias("rows"), *[median(F.array_sort(s["rows"][c])).alias(f"m{c}") for c in "uv"])

    def median(values: Column) -> Column:
        # as percentile does: between the two in the middle
        def middle(x: Column) -> Column:
            low, high = (F.get(x, (F.floor((F.size(x) - k) / 2)).cast("int")) for k in (1, 0))
            return F.when(F.size(x) % 2 == 1, low).otherwise(low * 0.5 + high * 0.5)

        return rot.let(values, middle)

    def summed(s: Column) -> Column:
        def add(t: Column, p: Column) -> Column:
            du, dv = p["u"] - s["mu"], p["v"] - s["mv"]
            parts = {"w": p["w"], "uu": p["w"] * du * du, "vv": p["w"] * dv * dv, "uv": p["w"] * du * dv, "e": p["w"] * (p["u"] * p["u"] + p["v"] * p["v"])}
            return F.struct(*[(t[c] + x).alias(c) for c, x in parts.items()])

        zero = F.struct(*[F.lit(0.0).alias(c) for c in ("w", "uu", "vv", "uv", "e")])
        return F.struct(s["n"].alias("n"), F.size(s["rows"]).cast("long").alias("kept"), F.aggregate(s["rows"], zero, add).alias("t"))

    def shares(s: Column) -> Column:
        of = lambda c: F.when(s["n"] > 0, s["t"][c] / F.when(s["t"]["w"] > 0, s["t"]["w"]))
        return F.struct(s["n"].alias("n"), s["kept"].alias("kept"), of("uu").alias("var_u"), of("vv").alias("var_v"), of("uv").alias("cov_uv"), F.sqrt(of("e")).alias("rmse"))

    ranked = F.array_sort(F.array_compact(F.transform(points, sized)))
    return rot.let(rot.let(rot.let(rot.let(ranked, clipped), centred), summed), shares)


def robust_covariance(points: DataFrame, u: str, v: str, w: str, by: str = "frame_id", q: float = 0.9) -> DataFrame:
    """by, n, kept, var_u, var_v, cov_uv and rmse of residuals as `covariance_of` has them; a frame's points are one row, as they are for its medians anyhow."""
    use = geo.finite(F.col(u), F.col(v), F.col(w)) & (F.col(w) > 0)
    rows = points.where(use).groupBy(by).agg(F.collect_list(F.struct(F.col(u).alias("u"), F.col(v).alias("v"), F.col(w).alias("w"))).alias("_p"))
    return rows.select(by, covariance_of(F.col("_p"), "u", "v", "w", q).alias("_c")).select(by, "_c.*")


def top_k(points: DataFrame, order: list[Column], k: int, by: str = "frame_id") -> DataFrame:
    """The first k rows of each frame in the given order, with their rank; a window limit Spark keeps small before the shuffle."""
    return points.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def scored(pairs: DataFrame, score: str, threshold: float, bounds: dict[str, int]) -> DataFrame:
    """Pairs whose score reaches the threshold (negative: any score) and whose indices lie in [0, bound)."""
    keep = F.lit(True) if threshold < 0 else F.col(score) >= threshold
    for index, bound in bounds.items():
        keep = keep & (F.col(index) >= 0) & (F.col(index) < bound)
    return pairs.where(keep)


def capped_pairs(pairs: DataFrame, score: str, most: int, ties: list[str], by: str = "frame_id") -> DataFrame:
    """The best pairs of each frame by score, at most `most` but four at least."""
    return top_k(pairs, [F.desc(score), *map(F.col, ties)], max(4, most), by)


def best_mode(pairs: DataFrame, mode: str, score: str, order: list[str], by: str = "frame_id") -> DataFrame:
    """by, mode, n and first_score of the mode with most pairs, then the higher score of its first pair, then the lesser mode."""
    modes = pairs.groupBy(by, mode).agg(F.count(F.lit(1)).alias("n"), F.min_by(score, F.struct(*order)).alias("first_score"))
    best = modes.groupBy(by).agg(F.max(F.struct("n", "first_score", (-F.col(mode)).alias("m"))).alias("b"))
    return best.select(by, (-F.col("b.m")).alias(mode), "b.n", "b.first_score")


def first_frames(frames: DataFrame, most: int, *order: str) -> DataFrame:
    """The first `most` frames in order; all of them for 0."""
    return frames.orderBy(*order).limit(most) if most > 0 else frames
