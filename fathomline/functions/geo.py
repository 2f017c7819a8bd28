"""Geodesy as column expressions: local radii, the WGS84 ellipsoid, and the mean-latitude sphere."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 semi-major axis, inverse flattening and first eccentricity squared as used by the local radii.
SEMI_MAJOR = 6378137.0
INVERSE_FLATTENING = 298.257223563
LOCAL_E2 = 6.69437999014e-3

_FLATTENING = 1.0 / INVERSE_FLATTENING
_E2 = _FLATTENING * (2.0 - _FLATTENING)
_SEMI_MINOR = SEMI_MAJOR * (1.0 - _FLATTENING)
_SECOND_E2 = (SEMI_MAJOR**2 - _SEMI_MINOR**2) / _SEMI_MINOR**2


class Enu(NamedTuple):
    east: Column
    north: Column
    up: Column


class Ecef(NamedTuple):
    x: Column
    y: Column
    z: Column


class Geo(NamedTuple):
    lon: Column
    lat: Column
    alt: Column


def finite(*values: Column) -> Column:
    """Neither null, NaN nor infinite, all of them."""
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(out, F.lit(False))


def null_if_not_finite(value: Column) -> Column:
    return F.when(finite(value), value)


def local_delta(lat0: Column, lon0: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """East and north metres from degrees, with the radii of curvature at lat0."""
    s = F.sin(F.radians(lat0))
    w2 = 1.0 - LOCAL_E2 * s * s
    prime_vertical = SEMI_MAJOR / F.sqrt(w2)
    meridian = SEMI_MAJOR * (1.0 - LOCAL_E2) / (w2 * F.sqrt(w2))
    return F.radians(lon - lon0) * prime_vertical * F.cos(F.radians(lat0)), F.radians(lat - lat0) * meridian


def to_ecef(g: Geo) -> Ecef:
    lat, lon = F.radians(g.lat), F.radians(g.lon)
    n = SEMI_MAJOR / F.sqrt(1.0 - _E2 * F.sin(lat) * F.sin(lat))
    return Ecef((n + g.alt) * F.cos(lat) * F.cos(lon), (n + g.alt) * F.cos(lat) * F.sin(lon), (n * (1.0 - _E2) + g.alt) * F.sin(lat))


def from_ecef(p: Ecef) -> Geo:
    """Bowring's formula, one step."""
    flat = F.hypot(p.x, p.y)
    theta = F.atan2(p.z * SEMI_MAJOR, flat * _SEMI_MINOR)
    lat = F.atan2(p.z + _SECOND_E2 * _SEMI_MINOR * F.pow(F.sin(theta), 3), flat - _E2 * SEMI_MAJOR * F.pow(F.cos(theta), 3))
    n = SEMI_MAJOR / F.sqrt(1.0 - _E2 * F.sin(lat) * F.sin(lat))
    return Geo(F.degrees(F.atan2(p.y, p.x)), F.degrees(lat), flat / F.cos(lat) - n)


def _axes(origin: Geo) -> tuple[tuple[Column, ...], ...]:
    la, lo = F.radians(origin.lat), F.radians(origin.lon)
    zero = F.lit(0.0)
    return (
        (-F.sin(lo), F.cos(lo), zero),
        (-F.sin(la) * F.cos(lo), -F.sin(la) * F.sin(lo), F.cos(la)),
        (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)),
    )


def enu_between(origin: Geo, point: Geo) -> Enu:
    """East, north and up of point seen from origin, on the ellipsoid."""
    a, b = to_ecef(origin), to_ecef(point)
    d = (b.x - a.x, b.y - a.y, b.z - a.z)
    return Enu(*(sum((axis[k] * d[k] for k in (1, 2)), axis[0] * d[0]) for axis in _axes(origin)))


def moved(origin: Geo, by: Enu) -> Ecef:
    """Where origin is after a move by metres."""
    axes = _axes(origin)
    return Ecef(*(c + axes[0][k] * by.east + axes[1][k] * by.north + axes[2][k] * by.up for k, c in enumerate(to_ecef(origin))))


def shift(origin: Geo, by: Enu) -> Geo:
    """origin moved by metres; its altitude changes by exactly up."""
    g = from_ecef(moved(origin, by))
    return Geo(g.lon, g.lat, origin.alt + by.up)


def horizontal_distance(a: Geo, b: Geo) -> Column:
    """Null unless every coordinate is finite."""
    e = enu_between(a, b)
    return F.when(finite(*a, *b), F.hypot(e.east, e.north))


def sphere_error(lon: Column, lat: Column, ref_lon: Column, ref_lat: Column) -> tuple[Column, Column]:
    """East and north metres on a sphere, with the cosine of the mean latitude."""
    mean = F.radians((lat + ref_lat) / 2.0)
    return F.radians(lon - ref_lon) * SEMI_MAJOR * F.cos(mean), F.radians(lat - ref_lat) * SEMI_MAJOR


def sphere_inverse(ref_lon: Column, ref_lat: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude from metres, with the cosine of the reference latitude."""
    return ref_lon + F.degrees(east / (SEMI_MAJOR * F.cos(F.radians(ref_lat)))), ref_lat + F.degrees(north / SEMI_MAJOR)


def field_of_view(width: Column, height: Column, diagonal_deg: Column) -> tuple[Column, Column]:
    """Horizontal and vertical degrees from the diagonal field of view; null outside (0, 180)."""
    d = F.hypot(width, height)
    half = F.tan(F.radians(diagonal_deg) / 2.0)
    ok = (diagonal_deg > 0) & (diagonal_deg < 180) & (width > 0) & (height > 0)
    return tuple(F.when(ok, F.degrees(2.0 * F.atan(side / d * half))) for side in (width, height))


def crop_half_extent(alt: Column, ground: Column, fov_deg: Column, fallback: Column, scale: Column) -> Column:
    """Half side in metres of a view from alt over ground; fallback times scale without a field of view."""
    wide = F.greatest(F.lit(1.0), scale)
    seen = F.greatest(F.lit(1.0), alt - ground) * F.tan(F.radians(fov_deg) / 2.0) * wide
    return F.when(finite(fov_deg, alt), F.greatest(F.lit(1.0), seen)).otherwise(fallback * wide)


def clamp_window(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """A pixel window within the raster, one pixel wide at least."""
    left = F.greatest(F.lit(0), F.least(x0, width - 1))
    top = F.greatest(F.lit(0), F.least(y0, height - 1))
    return left, top, F.greatest(left + 1, F.least(x1, width)), F.greatest(top + 1, F.least(y1, height))


def pixel_of(x: Column, y: Column, affine: tuple[float, ...]) -> tuple[Column, Column]:
    """Column and row of map coordinates under x = a0 + a1 col + a2 row, y = a3 + a4 col + a5 row."""
    a0, a1, a2, a3, a4, a5 = affine
    det = a1 * a5 - a2 * a4
    if abs(det) < 1e-15:
        raise ValueError("the affine transform can't be inverted")
    return (a5 * (x - a0) - a2 * (y - a3)) / det, (a1 * (y - a3) - a4 * (x - a0)) / det


def map_of(col: Column, row: Column, affine: tuple[float, ...]) -> tuple[Column, Column]:
    a0, a1, a2, a3, a4, a5 = affine
    return a0 + a1 * col + a2 * row, a3 + a4 * col + a5 * row


def rotate_offset(forward: Column, right: Column, heading: Column) -> tuple[Column, Column]:
    """East and north of a body offset at a compass heading."""
    return forward * F.sin(heading) + right * F.cos(heading), forward * F.cos(heading) - right * F.sin(heading)


def image_scale(cam_alt: Column, ground_alt: Column, fx: float, fy: float) -> Column:
    """Metres a pixel under the camera."""
    return F.abs(cam_alt - ground_alt) / math.sqrt(fx * fy)
