"""Heading from positions: least squares over the last rows, carried forward while it isn't valid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.angles import compass_of
from fathomline.functions.geo import LOCAL_E2, SEMI_MAJOR


def window_length(seconds: float, rate: float) -> int:
    """Rows of a window: by count, not by time."""
    return max(3, int(seconds * rate))


def velocity(fixes: DataFrame, rows: int = 15, by: str = "vehicle_id") -> DataFrame:
    """fixes with n, v_east, v_north and rms of a straight line through the last rows (null for fewer than 3 or equal times).

    Metres come from the radii at the window's first point.  They scale each axis as a whole, so slopes
    and sums of squares of degrees need one factor afterwards and no list of points.
    """
    w = Window.partitionBy(by).orderBy("t", "seq").rowsBetween(-(rows - 1), 0)
    lat0 = F.radians(F.first("lat").over(w))
    # centred on the row itself: large stamps would cost digits
    n, tt = F.count(F.lit(1)).over(w), F.regr_sxx("lon", "t").over(w)
    sums = fixes.withColumns(
        {
            "n": n,
            "_lat0": lat0,
            "_tt": tt,
            "_te": F.regr_sxy("lon", "t").over(w),
            "_ee": F.regr_syy("lon", "t").over(w),
            "_tn": F.regr_sxy("lat", "t").over(w),
            "_nn": F.regr_syy("lat", "t").over(w),
        }
    )
    s2 = F.pow(F.sin("_lat0"), 2)
    w2 = 1.0 - LOCAL_E2 * s2
    to_east = SEMI_MAJOR / F.sqrt(w2) * F.cos("_lat0") * math.pi / 180.0
    to_north = SEMI_MAJOR * (1.0 - LOCAL_E2) / (w2 * F.sqrt(w2)) * math.pi / 180.0
    ok = (F.col("n") >= 3) & (F.col("_tt") > 0)
    east, north = F.try_divide(F.col("_te"), F.col("_tt")), F.try_divide(F.col("_tn"), F.col("_tt"))
    rest_east = F.greatest(F.lit(0.0), F.col("_ee") - east * F.col("_te")) * to_east * to_east
    rest_north = F.greatest(F.lit(0.0), F.col("_nn") - north * F.col("_tn")) * to_north * to_north
    out = sums.withColumns(
        {
            "v_east": F.when(ok, east * to_east),
            "v_north": F.when(ok, north * to_north),
            "rms": F.when(ok, F.sqrt((rest_east + rest_north) / F.col("n"))),
        }
    )
    return out.drop("_lat0", "_tt", "_te", "_ee", "_tn", "_nn")


def headings(fixes: DataFrame, rows: int = 15, min_speed: float = 0.5, max_rms: float = 1.0, by: str = "vehicle_id") -> DataFrame:
    """velocity with speed, valid and compass heading; an invalid row keeps the last valid heading.

    Before the first valid row the heading is the fitted one, or east if there is no fit.
    """
    fitted = velocity(fixes, rows, by).withColumn("speed", F.hypot("v_east", "v_north"))
    fitted = fitted.withColumn("valid", F.coalesce((F.col("speed") >= min_speed) & (F.col("rms") <= max_rms), F.lit(False)))
    own = F.atan2("v_north", "v_east")
    before = Window.partitionBy(by).orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    kept = F.last(F.when(F.col("valid"), own), True).over(before)
    return fitted.withColumn("heading", compass_of(F.coalesce(kept, own, F.lit(0.0))))
