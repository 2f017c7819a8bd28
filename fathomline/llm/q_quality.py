"""Query op4: perplexity of every document under the trusted model, and whether it is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.common import table
from fathomline.llm.kneser_ney import judge


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, table(spark, sf_dir, "labels")).select("doc_id", "lang", "n_tokens", F.pow(F.lit(10.0), "perplexity").alias("perplexity"), "kept")


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLES: dict[str, str] = {}
