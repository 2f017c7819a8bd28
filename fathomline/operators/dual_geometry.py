"""Two geometries of a frame held against each other: the homography's and the pose's predictions of the same points.

Residuals of both against what was seen, and against each other, give a pixel covariance; the Jacobian of
the projection at the weighted reference point takes it to the ground.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import geo, vision
from fathomline.functions import rotations as rot
from fathomline.operators import frames

#: Points that a frame needs, and what the pixel covariance is mixed of.
LEAST, MIX, NOISE = 4, {"h": 0.25, "p": 0.25, "d": 0.5}, 1e-4
#: Beyond this condition the Jacobian is inverted as J'J with this ridge.
MOST_CONDITION, RIDGE = 1e4, 1e-6
LEAST_WEIGHT = 1e-3
POINT = ("u", "v", "hu", "hv", "x", "y", "z", "score")


def project(r: Column, t: Column, point: tuple[Column, Column, Column], camera: tuple[Column, ...]) -> tuple[Column, Column]:
    """Pixels of a world point under a pose (world to camera: r by rows, t); camera: fx, fy, cx, cy."""
    m, shift, (fx, fy, cx, cy) = rot.parts(r, 9), rot.parts(t, 3), camera
    x, y, z = (rot.dot(m[3 * k : 3 * k + 3], list(point)) + shift[k] for k in range(3))
    return fx * F.try_divide(x, z) + cx, fy * F.try_divide(y, z) + cy


def transformed(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a homography (array of 9, by rows); null on the horizon."""
    m = rot.parts(h, 9)
    w = m[6] * x + m[7] * y + m[8]
    w = F.when(F.abs(w) > 1e-12, w)
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def homography_predictions(points: DataFrame, homographies: DataFrame, map_scale: tuple[float, float], cam_scale: tuple[float, float], by: str = "frame_id") -> DataFrame:
    """points (by, map_x, map_y) with hu and hv, where the frame's homography (by, h) sees the map point in the image."""
    if min(*map_scale, *cam_scale) <= 0:
        raise ValueError("scales have to be positive")
    met = points.join(homographies.select(F.col(by).alias("_by"), "h"), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    u, v = transformed(F.col("h"), F.col("map_x") / map_scale[0], F.col("map_y") / map_scale[1])
    return met.withColumns({"hu": u * cam_scale[0], "hv": v * cam_scale[1]}).drop("h")


def pose_obliqueness(r: Column) -> Column:
    """Degrees between the optical axis of a pose and straight down."""
    return vision.obliqueness(*(F.get(r, F.lit(k)) for k in (6, 7, 8)))


def jacobian(r: Column, t: Column, point: tuple[Column, Column, Column], camera: tuple[Column, ...], step: float = 1.0) -> Column:
    """Array of pixels a metre, du/dx, du/dy, dv/dx, dv/dy, by central differences on the ground."""
    x, y, z = point
    (ue, ve), (uw, vw) = (project(r, t, (x + d, y, z), camera) for d in (step, -step))
    (un, vn), (us, vs) = (project(r, t, (x, y + d, z), camera) for d in (step, -step))
    return F.array(*[(a - b) / (2 * step) for a, b in ((ue, uw), (un, us), (ve, vw), (vn, vs))])


def pixel_to_ground(j: Column) -> Column:
    """The inverse of a 2 x 2 Jacobian, or its ridge pseudo-inverse if it is ill-conditioned."""
    a, b, c, d = rot.parts(j, 4)
    det = a * d - b * c
    plain = F.array(d / det, -b / det, -c / det, a / det)
    p, q, s = a * a + c * c + RIDGE, a * b + c * d, b * b + d * d + RIDGE
    size = p * s - q * q
    ridge = F.array((s * a - q * b) / size, (s * c - q * d) / size, (p * b - q * a) / size, (p * d - q * c) / size)
    condition = vision.condition_2x2(a, b, c, d)
    return F.when(geo.finite(condition) & (condition <= MOST_CONDITION), plain).when(F.abs(size) > 0, ridge)


def statistics(points: DataFrame, poses: DataFrame, by: str = "frame_id") -> DataFrame:
    """One row a frame: shared, rmse_h, rmse_p, rmse_d, px_var_u, px_cov_uv, px_var_v, j (Jacobian), condition, scale_u, scale_v, scale, var_x, var_y and valid.

    points: by, u, v (seen), hu, hv (the homography's prediction), x, y, z (on the ground) and score; poses: by, r, t, fx, fy, cx, cy.
    Points without a finite prediction are left out; a frame with fewer than LEAST, or without a pose, has nulls and is not valid.
    """
    camera = tuple(F.col(c) for c in ("fx", "fy", "cx", "cy"))
    own = poses.select(F.col(by).alias("_by"), F.struct("r", "t", *camera).alias("_pose"))
    met = points.join(own, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, *POINT, "_pose", *[F.col(f"_pose.{c}").alias(c) for c in ("r", "t", "fx", "fy", "cx", "cy")])
    pu, pv = project(F.col("r"), F.col("t"), (F.col("x"), F.col("y"), F.col("z")), camera)
    met = met.withColumns({"pu": pu, "pv": pv, "w": F.greatest("score", F.lit(LEAST_WEIGHT))})
    met = met.withColumn("_ok", F.coalesce(geo.finite(*map(F.col, ("u", "v", "hu", "hv", "pu", "pv"))), F.lit(False)))
    residuals = {"h": ("hu - u", "hv - v"), "p": ("pu - u", "pv - v"), "d": ("pu - hu", "pv - hv")}
    gaps = [F.expr(e).alias(f"{k}{axis}") for k, pair in residuals.items() for axis, e in zip("uv", pair, strict=True)]
    rows = met.select(by, "_ok", "_pose", F.when(F.col("_ok"), F.struct("w", "x", "y", "z", *gaps)).alias("_p"))
    # one shuffle: all that is known of a frame follows from its points and its pose
    weighted = {c: F.sum(F.col("_p.w") * F.col(f"_p.{c}")) / F.sum("_p.w") for c in "xyz"}
    every = rows.groupBy(by).agg(F.count_if("_ok").alias("shared"), F.first("_pose").alias("_pose"), F.collect_list("_p").alias("_points"), *[c.alias(name) for name, c in weighted.items()])
    out = every.select(by, "shared", "_pose", "x", "y", "z", *[F.when(F.col("shared") >= LEAST, frames.covariance_of(F.col("_points"), f"{k}u", f"{k}v")).alias(f"_{k}") for k in residuals])
    known = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_{k}.n") > 0, F.lit(False)) for k in residuals])
    out = out.select(by, "shared", "x", "y", "z", F.when(known, F.col("_pose")).alias("_pose"), *[F.when(known, F.col(f"_{k}.{c}")).alias(f"{k}_{c}") for k in residuals for c in ("var_u", "cov_uv", "var_v", "rmse")])
    out = out.select("*", "_pose.*")
    mixed = lambda c, more: sum((share * F.col(f"{k}_{c}") for k, share in MIX.items()), F.lit(more))
    out = out.withColumns({"px_var_u": mixed("var_u", NOISE), "px_cov_uv": mixed("cov_uv", 0.0), "px_var_v": mixed("var_v", NOISE)})
    out = out.withColumn("j", jacobian(F.col("r"), F.col("t"), (F.col("x"), F.col("y"), F.col("z")), camera))
    out = out.withColumns({"condition": vision.condition_2x2(*rot.parts(F.col("j"), 4)), "_g": pixel_to_ground(F.col("j"))})
    xu, xv, yu, yv = rot.parts(F.col("_g"), 4)
    spread = lambda a, b: a * a * F.col("px_var_u") + 2 * a * b * F.col("px_cov_uv") + b * b * F.col("px_var_v")
    out = out.withColumns({"scale_u": F.hypot(xu, yu), "scale_v": F.hypot(xv, yv), "var_x": spread(xu, xv), "var_y": spread(yu, yv)})
    out = out.withColumn("scale", F.when((F.col("scale_u") > 0) & (F.col("scale_v") > 0), (F.col("scale_u") + F.col("scale_v")) / 2))
    valid = geo.finite(F.col("var_x"), F.col("var_y"), F.col("scale")) & (F.col("var_x") >= 0) & (F.col("var_y") >= 0)
    names = ["px_var_u", "px_cov_uv", "px_var_v", "j", "condition", "scale_u", "scale_v", "scale", "var_x", "var_y"]
    return out.select(by, "shared", *[F.col(f"{k}_rmse").alias(f"rmse_{k}") for k in MIX], *names, F.coalesce(valid, F.lit(False)).alias("valid"))
