"""Files of a flight: point tables, key=value reports, world files, camera text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.geo import finite


def number(text: Column) -> Column:
    """A finite number from text; blank and nan are null, other text is an error."""
    t = F.lower(F.trim(text))
    return F.when(t.isNull() | t.isin("", "nan", "null"), None).otherwise(t.cast("double"))


def integer(text: Column) -> Column:
    """A whole number, halves to even; null where there is none."""
    return F.bround(F.try_cast(F.trim(text), "double") if hasattr(F, "try_cast") else F.trim(text).try_cast("double"), 0).cast("long")


def resolve(df: DataFrame, *candidates: str) -> str:
    """The first of the column names that df has."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of the columns {', '.join(candidates)} is there")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of a table with a header, all as text."""
    return spark.read.csv(path, header=True)


def csv_points(spark: SparkSession, path: str, columns: dict[str, tuple[str, ...]], available: str | None = None, strict: bool = False) -> DataFrame:
    """Number columns by name, each from the first of its candidate columns.

    Rows with a value that isn't finite are dropped, or are an error if strict.  available: only rows
    where this column is 1.
    """
    raw = csv_rows(spark, path)
    if available is not None:
        raw = raw.where(number(F.col(available)) == 1)
    out = raw.select(*[number(F.col(resolve(raw, *names))).alias(c) for c, names in columns.items()])
    good = finite(*[F.col(c) for c in columns])
    if strict:
        return out.where(F.when(good, True).otherwise(F.raise_error(F.lit("a row has a missing or infinite number"))))
    return out.where(good)


def reports(spark: SparkSession, path: str) -> DataFrame:
    """file and values (map) of key=value texts; a line is split at its first =, the last of equal keys stands."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("l"))
    pairs = F.transform(F.filter("l", lambda x: F.instr(x, "=") > 0), lambda x: F.split(x, "=", 2))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(p[0]).alias("key"), F.trim(p[1]).alias("value")))
    last = F.filter(entries, lambda e, k: ~F.exists(F.slice(entries, k + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return lines.select("file", F.map_from_entries(last).alias("values"))


def report_numbers(found: DataFrame, names: list[str]) -> DataFrame:
    """file and the named values as numbers; a missing rate (`x_rate`) comes from x_count over total_count."""
    cols = []
    for name in names:
        value = number(F.try_element_at("values", F.lit(name)))
        if name.endswith("_rate"):
            count = number(F.try_element_at("values", F.lit(name.removesuffix("_rate") + "_count")))
            whole = number(F.try_element_at("values", F.lit("total_count")))
            value = F.coalesce(value, F.when(whole > 0, count / whole))
        cols.append(value.alias(name))
    return found.select("file", *cols)


def world_file(spark: SparkSession, path: str) -> tuple[float, ...]:
    """The affine transform (a0 to a5, see geo.map_of) of a six-line world file, whose origin is a pixel's centre."""
    xres, d, b, yres, x, y = (float(r["value"]) for r in spark.read.text(path).where("trim(value) <> ''").limit(6).collect())
    return (x - 0.5 * xres - 0.5 * b, xres, b, y - 0.5 * d - 0.5 * yres, d, yres)


def thresholds(text: str) -> list[float]:
    """Positive numbers of a comma-separated text, sorted, each once."""
    values = sorted({float(part) for part in text.split(",") if part.strip()})
    if not values or values[0] <= 0:
        raise ValueError("thresholds must be positive numbers")
    return values
