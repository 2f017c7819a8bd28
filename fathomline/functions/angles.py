"""Angles in radians as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def wrap_to_pi(angle: Column) -> Column:
    """Into (-pi, pi]."""
    turned = (angle + math.pi) % TWO_PI
    return F.when(turned <= 0, turned + TWO_PI).otherwise(turned) - math.pi


def wrap_to_two_pi(angle: Column) -> Column:
    """Into [0, 2 pi)."""
    return F.pmod(angle, F.lit(TWO_PI))


def compass_of(angle: Column) -> Column:
    """Clockwise from north, from counter-clockwise from east."""
    return wrap_to_two_pi(math.pi / 2 - angle)


def lerp_angle(one: Column, other: Column, share: Column) -> Column:
    """Along the shorter arc."""
    return one + share * wrap_to_pi(other - one)
