"""Rasters as pixel tables (row, col, value): bilinear samples, windows, robust stretch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.geo import clamp_window, finite, pixel_of


def bilinear(points: DataFrame, pixels: DataFrame, key: str, col: str, row: str, shape: tuple[int, int], nodata: float | None = None) -> DataFrame:
    """points with sample, inner: rows without four valid pixels or outside [0, size - 1] are dropped.

    Each point joins its four pixels by (row, col) and the weighted sum is taken by key, which must be
    unique; weights of zero at the edges still ask for a valid pixel.
    """
    height, width = shape
    c0, r0 = F.least(F.floor(col), F.lit(width - 2)), F.least(F.floor(row), F.lit(height - 2))
    inside = F.col(col).between(0, width - 1) & F.col(row).between(0, height - 1)
    dx, dy = F.col(col) - c0, F.col(row) - r0
    corners = F.array(*[
        F.struct((c0 + i).alias("col"), (r0 + j).alias("row"), ((dx if i else 1 - dx) * (dy if j else 1 - dy)).alias("weight")) for i in (0, 1) for j in (0, 1)
    ])
    wanted = points.where(inside).select(key, F.explode(corners).alias("c")).select(key, "c.*")
    valid = pixels.where(finite(F.col("value")) & (F.lit(True) if nodata is None else F.col("value") != nodata))
    hits = wanted.join(valid.select("row", "col", "value"), ["row", "col"])
    sums = hits.groupBy(key).agg(F.sum(F.col("weight") * F.col("value")).alias("sample"), F.count(F.lit(1)).alias("_n")).where("_n = 4")
    return points.join(sums.drop("_n"), key)


def box_windows(boxes: DataFrame, affine: tuple[float, ...], width: int, height: int) -> DataFrame:
    """boxes (west, south, east, north) with the clamped pixel window x0, y0, x1, y1 that covers their corners."""
    corners = [pixel_of(F.col(x), F.col(y), affine) for x in ("west", "east") for y in ("south", "north")]
    cols, rows = [c for c, _ in corners], [r for _, r in corners]
    raw = (F.floor(F.least(*cols)), F.floor(F.least(*rows)), F.ceil(F.greatest(*cols)), F.ceil(F.greatest(*rows)))
    window = clamp_window(*raw, F.lit(width), F.lit(height))
    return boxes.withColumns(dict(zip(("x0", "y0", "x1", "y1"), [w.cast("long") for w in window], strict=True)))


def stretch(pixels: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """pixels with grey 0 to 255 between the floor quantiles of the finite values."""
    values = pixels.where(finite(F.col("value")))
    n = values.count()
    # The element at floor(q (n - 1)) has (that + 1) / n of the values at or below it.
    at = [(int(q * (n - 1)) + 0.5) / n for q in (low, high)] if n else [0.5, 0.5]
    got = values.agg(*[F.expr(f"percentile_disc({q!r}) WITHIN GROUP (ORDER BY value)").alias(f"_{k}") for k, q in enumerate(at)]).first()
    lo, hi = got["_0"], got["_1"]
    share = F.lit(0.0) if lo is None or hi <= lo else (F.col("value") - lo) / (hi - lo)
    return pixels.withColumn("grey", F.when(finite(F.col("value")), F.round(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).cast("int")))
