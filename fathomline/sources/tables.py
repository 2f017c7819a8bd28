"""Trajectory views of the driver's tables (the mapping of FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """vehicle_id, t, seq, lon, lat, alt, kind, k of the events; kind keeps one event type."""
    events = table(spark, sf_dir, "events")
    if kind is not None:
        events = events.where(F.col("event_type") == kind)
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return events.select(
        F.col("user_id").alias("vehicle_id"),
        (micros / 1e6).alias("t"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("kind"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    ).withColumns(
        {
            "lon": 109.0 + F.col("t") / 86400 * 0.01 + F.col("value") * 1e-5,
            "lat": 34.0 + F.col("t") / 86400 * 0.005 + F.col("value") * 5e-6,
            "alt": 400.0 + F.col("value"),
        }
    )


#: The same views for DuckDB.
SAMPLES_SQL = """
samples AS (
  SELECT vehicle_id, t, seq, kind, value, k, 109.0::DOUBLE + t / 86400 * 0.01::DOUBLE + value * 1e-5::DOUBLE AS lon,
         34.0::DOUBLE + t / 86400 * 0.005::DOUBLE + value * 5e-6::DOUBLE AS lat, 400.0::DOUBLE + value AS alt
  FROM (SELECT user_id AS vehicle_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6::DOUBLE AS t, event_id AS seq,
               event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""
