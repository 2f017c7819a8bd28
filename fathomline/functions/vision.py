"""Gates, variance models and scores of vision measurements as column expressions (null stands for missing)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions.decimals import fixed_text
from fathomline.functions.geo import finite

# Fixed values: (feature, reference, slope) of the fitted variance trends, and their clips.
X_TREND = (
    ("reproj", 2.432221685, 2.408108378560803),
    ("pnp_rate", 0.87037037, -1.4013746091746202),
    ("homography_rate", 0.5821840149999999, -2.6099066443146337),
    ("spread", 0.548319605, -0.7602740316102015),
    ("depth", 73.29779595, -4.040753789430454),
    ("obliqueness", 15.329001485, -0.7383878156800521),
)
X_CLIP = (0.8, 4.0)
Y_TREND = (
    ("reproj", 2.432221685, 1.204661918117212),
    ("pnp_rate", 0.87037037, -1.6854797117431217),
    ("homography_rate", 0.5821840149999999, -0.6768314253096079),
    ("h_rmse", 2.296074, 2.704897772110435),
    ("obliqueness", 15.329001485, 0.24877347196563604),
)
Y_CLIP = (0.4, 2.5)
# Intercept and weights of the log variance of altitude.
Z_INTERCEPT = -0.7629712389036853
Z_WEIGHTS = {"reproj": 2.59690597871322, "relief": -3.660977674357853, "inliers": 1.3849830922402342, "pnp_rate": -3.22296166062672}


def ratio(part: Column, whole: Column) -> Column:
    """Null unless whole is positive."""
    return F.when(whole > 0, part / whole)


def reject_reason(used: Column, inlier_ratio: Column, reproj: Column, min_used: int, min_ratio: float, max_reproj: float) -> Column:
    """First failing check of a measurement, or null; a missing ratio fails, a missing error passes."""
    return (
        F.when(used < min_used, "anchor_rejected_low_used_points")
        .when(~finite(inlier_ratio) | (inlier_ratio < min_ratio), "anchor_rejected_low_inlier_ratio")
        .when(finite(reproj) & (reproj > max_reproj), "anchor_rejected_high_reproj_error")
    )


def nis_passes(nis: Column, gate: Column) -> Column:
    return ~finite(nis) | (gate <= 0) | (nis <= gate)


def innovation_gate(base: Column, gain: Column, speed: Column, dt: Column) -> Column:
    return base + gain * F.greatest(F.lit(0.0), speed) * F.greatest(F.lit(0.0), dt)


def anchor_age(now: Column, anchor: Column) -> Column:
    return F.greatest(F.lit(0.0), now - anchor)


def expired(age: Column, most: Column) -> Column:
    return (most > 0) & (age > most)


def heading_failure(available: Column, slow: Column, bent: Column) -> Column:
    """Why a heading isn't valid."""
    return (
        F.when(~available, "heading_unavailable")
        .when(slow & bent, "low_speed_and_high_residual")
        .when(slow, "low_speed")
        .when(bent, "high_residual")
        .otherwise("heading_invalid")
    )


def trend_multiplier(values: dict[str, Column], trend: tuple, clip: tuple[float, float]) -> Column:
    """exp of summed slopes times log ratios, clipped; null if a value isn't positive."""
    total, ok = F.lit(0.0), F.lit(True)
    for name, reference, slope in trend:
        v = values[name]
        ok = ok & finite(v) & (v > 0)
        total = total + slope * F.ln(F.when(v > 0, v) / reference)
    return F.when(ok, F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), F.exp(total))))


def axis_variances(values: dict[str, Column], var_x: Column, var_y: Column) -> tuple[Column, Column, Column]:
    """Predicted variances of x, y and z, null where a feature is missing."""
    x = F.when(finite(var_x) & (var_x > 0), var_x * trend_multiplier(values, X_TREND, X_CLIP))
    y = F.when(finite(var_y) & (var_y > 0), var_y * trend_multiplier(values, Y_TREND, Y_CLIP))
    log = lambda v: F.when(finite(v) & (v > 0), F.ln(F.greatest(F.when(v > 0, v), F.lit(1e-6))))
    inliers = values["inliers"]
    log_inliers = F.when(finite(inliers) & (inliers >= 0), F.log1p(F.greatest(inliers, F.lit(0.0))))
    logs = {"reproj": log(values["reproj"]), "relief": log(values["relief"]), "inliers": log_inliers, "pnp_rate": log(values["pnp_rate"])}
    z = F.lit(Z_INTERCEPT)
    for name, weight in Z_WEIGHTS.items():
        z = z + weight * logs[name]
    return x, y, F.exp(z)


def chosen_variance(preferred: Column, fallback: Column, floor: float) -> Column:
    """The preferred variance, else the fallback, either no less than floor; else floor."""
    good = lambda v: finite(v) & (v > 0)
    low = F.lit(floor)
    return F.when(good(preferred), F.greatest(preferred, low)).when(good(fallback), F.greatest(fallback, low)).otherwise(low)


def measurement_variances(predicted: tuple[Column, Column, Column], var_x: Column, var_y: Column, scale: Column, min_xy: float, min_z: float) -> tuple[Column, ...]:
    floor_xy, floor_z = max(1e-6, min_xy**2), max(1e-6, min_z**2)
    spare_z = F.when(finite(scale) & (scale > 0), F.greatest(F.lit(floor_z), F.pow(4.0 * scale, 2))).otherwise(floor_z)
    x, y, z = predicted
    return chosen_variance(x, var_x, floor_xy), chosen_variance(y, var_y, floor_xy), chosen_variance(z, spare_z, floor_z)


def nis3(v: tuple[Column, Column, Column], s: tuple[Column, ...]) -> Column:
    """Normalised innovation squared; s: xx, xy, xz, yy, yz, zz of a symmetric matrix; null if singular or negative."""
    xx, xy, xz, yy, yz, zz = s
    a, b, c = yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy
    d, e, f = xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy
    det = xx * a + xy * b + xz * c
    x, y, z = v
    form = x * (a * x + b * y + c * z) + y * (b * x + d * y + e * z) + z * (c * x + e * y + f * z)
    out = F.try_divide(form, det)
    return F.when(finite(out) & (out >= 0), out)


def adapted_scale(scale: Column, nis: Column, target: float, alpha: float, low: float, high: float) -> Column:
    """A covariance scale moved by how far a measurement's nis is from its target."""
    moved = scale * F.pow(F.greatest(F.lit(0.25), F.least(F.lit(4.0), nis / target)), alpha)
    return F.when(finite(nis), F.greatest(F.lit(low), F.least(F.lit(high), moved))).otherwise(scale)


def match_score(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def heading_weights(yaw: Column) -> tuple[Column, Column]:
    return F.pow(F.sin(yaw), 2), F.pow(F.cos(yaw), 2)


def condition_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Ratio of the singular values of a 2 x 2 matrix; null if it is singular."""
    trace, det = a * a + b * b + c * c + d * d, a * d - b * c
    root = F.sqrt(F.greatest(F.lit(0.0), trace * trace / 4.0 - det * det))
    return F.when(F.abs(det) >= 1e-12, F.sqrt(F.try_divide(trace / 2.0 + root, trace / 2.0 - root)))


def obliqueness(x: Column, y: Column, z: Column) -> Column:
    """Degrees between a camera's optical axis, given in world axes, and straight down; null without a direction."""
    length = F.sqrt(x * x + y * y + z * z)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -z / F.when(length > 1e-12, length)))
    return F.when(finite(length) & (length > 1e-12), F.degrees(F.acos(cosine)))


def variance_text(x: Column, y: Column, z: Column) -> Column:
    texts = [F.coalesce(fixed_text(v, 9), F.lit("null")) for v in (x, y, z)]
    return F.concat(F.lit("["), F.concat_ws(",", *texts), F.lit("]"))
