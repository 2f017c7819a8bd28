"""Doubles of fixed decimals: as text the way C writes it, from all binary digits and ties to even; as numbers the way the SQL rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_text(value: Column, digits: int) -> Column:
    """The value with `digits` decimals, null for null.

    format_string rounds the shortest text that reads back as the value: a double just below 109.1826416835 gets one too
    many at nine decimals, an exact half goes up, and digits past the 17th become zeros.  Python's format is C's.
    """

    @F.arrow_udf("string")
    def text(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f"{x:.{digits}f}" for x in values.to_pylist()], pa.string())

    return text(value.cast("double"))


def rounded_to(value: Column, digits: int) -> Column:
    """The double rounded as the SQL's round does it: scaled by a power of ten, brought to the nearest whole number, halves away from zero.

    Spark's round takes the shortest text of the value instead: 517.1203125 becomes 517.120313, and 517.120312 in the SQL.
    """
    whole = F.round(value * 10.0**digits)
    return F.when(F.abs(whole) < float("inf"), whole / 10.0**digits).otherwise(value)
