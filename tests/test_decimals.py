"""Fixed decimals are those of C's printf, which Python has too."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from fathomline.functions import vision
from fathomline.functions.decimals import fixed_text
from fathomline.operators import sinks


def values():
    rng = random.Random(4)
    # halves as texts have them, exact halves, what rounds over, long stamps, both zeros
    yield from (109.1826416835, 34.0913208415, 0.0009765625, 0.0029296875, 2.5e-10, 5e-10, 1.5e-9, 0.9999999995, 0.9999999999, 1.9999999996, 999999.9999999996)
    yield from (123456789.1, 1700000000.123456, 1e15 + 0.125, 2.0**53 - 1, 2.0**62, 0.0, -0.0, -1e-12, -109.1826416835, 5e-324, 1e-300, None)
    for _ in range(4000):
        yield round(rng.uniform(-200, 200), 9) + 5e-10
        yield rng.uniform(-3e9, 3e9)
        yield rng.uniform(0, 1) * 10.0 ** rng.randrange(-12, 16)
        yield rng.randrange(1 << 20) / (1 << rng.randrange(1, 14))
    for _ in range(4000):
        yield struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0]


@pytest.mark.parametrize("digits", [0, 5, 9])
def test_as_printf(spark, digits):
    given = list(values())
    df = spark.createDataFrame([(x,) for x in given], "x double").select("x", fixed_text(F.col("x"), digits).alias("text"))
    for x, text in df.collect():
        assert text == (None if x is None else f"{x:.{digits}f}"), x


def test_rows_and_variances(spark):
    df = spark.createDataFrame([(109.1826416835, float("nan"), None)], "a double, b double, c double")
    assert sinks.csv_lines(df, dict.fromkeys("abc", 9)).first()[0] == f"{109.1826416835:.9f},nan,nan"
    assert df.select(vision.variance_text(df.a, df.a, df.c)).first()[0] == f"[{109.1826416835:.9f},{109.1826416835:.9f},null]"
