"""Query op7: all documents into forty shards of equal row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.common import table
from fathomline.llm.sharding import shuffle_to_shards


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shuffle_to_shards(docs, shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op7_shards": op7_shards}
ORACLES: dict[str, str] = {}
