"""Query op6: secrets of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.common import table
from fathomline.llm.secrets import find_secrets


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col("secrets")
    return found.select("doc_id", s["n_assign"].alias("n_assign"), s["n_access"].alias("n_access"), s["n_hex"].alias("n_hex"), F.sha2(s["base_spans"], 256).alias("base_sha256"), s["spans"].alias("spans"))


QUERIES = {"op6_secrets": op6_secrets}
ORACLES: dict[str, str] = {}
