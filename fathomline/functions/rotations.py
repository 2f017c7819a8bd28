"""Vectors (array of 3) and rotation matrices (array of 9, by rows) as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions.geo import finite


def parts(array: Column, n: int) -> list[Column]:
    return [F.get(array, F.lit(k)) for k in range(n)]


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def length(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: what is used several times in one expression is bound so."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rotation_of(vector: Column) -> Column:
    """Rodrigues' formula for a rotation vector."""

    def sized(v: Column) -> Column:
        return F.struct(v.alias("v"), length(parts(v, 3)).alias("angle"))

    def terms(s: Column) -> Column:
        angle, small = s["angle"], s["angle"] < 1e-12
        sine = F.when(small, 1.0).otherwise(F.sin(angle) / angle)
        cosine = F.when(small, 0.0).otherwise((1 - F.cos(angle)) / (angle * angle))
        return F.struct(s["v"].alias("v"), sine.alias("s"), cosine.alias("c"))

    def built(s: Column) -> Column:
        (x, y, z), sine, cosine = parts(s["v"], 3), s["s"], s["c"]
        return F.array(
            1 - cosine * (y * y + z * z), cosine * x * y - sine * z, cosine * x * z + sine * y,
            cosine * x * y + sine * z, 1 - cosine * (x * x + z * z), cosine * y * z - sine * x,
            cosine * x * z - sine * y, cosine * y * z + sine * x, 1 - cosine * (x * x + y * y),
        )

    return let(let(let(vector, sized), terms), built)


def product(a: Column, b: Column) -> Column:
    def made(s: Column) -> Column:
        m, n = parts(s["a"], 9), parts(s["b"], 9)
        return F.array(*[dot(m[3 * i : 3 * i + 3], [n[j], n[3 + j], n[6 + j]]) for i in range(3) for j in range(3)])

    return let(F.struct(a.alias("a"), b.alias("b")), made)


def turned(frame: Column, vector: Column) -> Column:
    """vector through the orthonormal frame whose first two columns are those of `frame` by Gram-Schmidt."""

    def unit(a: Column) -> Column:
        return let(a, lambda v: let(length(parts(v, 3)), lambda size: F.transform(v, lambda c: c / size)))

    def first(s: Column) -> Column:
        r = parts(s["r"], 9)
        return F.struct(unit(F.array(r[0], r[3], r[6])).alias("x"), F.array(r[1], r[4], r[7]).alias("y"), s["v"].alias("v"))

    def second(s: Column) -> Column:
        along = dot(parts(s["x"], 3), parts(s["y"], 3))
        off = let(along, lambda d: F.zip_with(s["x"], s["y"], lambda a, b: b - d * a))
        return F.struct(s["x"].alias("x"), unit(off).alias("y"), s["v"].alias("v"))

    def last(s: Column) -> Column:
        x, y, v = parts(s["x"], 3), parts(s["y"], 3), parts(s["v"], 3)
        return F.array(*[a * v[0] + b * v[1] + c * v[2] for a, b, c in zip(x, y, cross(x, y), strict=True)])

    return let(let(let(F.struct(frame.alias("r"), vector.alias("v")), first), second), last)


def scaled(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda v: v * by)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def limited(a: Column, most: float) -> Column:
    """a, shortened to the length `most` (0: no limit)."""
    if most <= 0:
        return a
    return let(a, lambda v: let(length(parts(v, 3)), lambda size: F.when(size > most, scaled(v, most / size)).otherwise(v)))


def heading_of(r: Column) -> Column:
    """Compass angle of the forward axis."""
    return F.atan2(F.get(r, F.lit(0)), F.get(r, F.lit(3)))


def all_finite(array: Column, n: int = 3) -> Column:
    return finite(*parts(array, n))
