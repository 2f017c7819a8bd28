"""Query op2: rule figures and the kept flag of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm.common import table
from fathomline.llm.rules import judge


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES: dict[str, str] = {}
