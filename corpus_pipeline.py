"""Training corpus pipeline: quality, near duplicates, decontamination, secrets, tokens.

Every stage works on all documents its predecessor kept, written as Parquet and read again.  Stages
but the last return the columns of documents.

Defined results: documents with null or empty text pass every filter; of each group of near
duplicates the least doc_id stays (of rows with equal id and text, one); a benchmark item found in a document drops it; secrets are
replaced by a mark in the text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.common import cut, table
from fathomline.llm.decontaminate import drop_contaminated, identity, same_rows
from fathomline.llm.kneser_ney import drop_rejected
from fathomline.llm.near_dups import near_duplicates
from fathomline.llm.q_bpe import encoded
from fathomline.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8); documents without a word stay.

    A document is its id and text: other texts under the same id are documents of their own, and of rows equal in
    both the first by all columns stays.
    """
    marked = docs.withColumn("_row", identity())
    judged = cut(near_duplicates(marked.select("_row", "text"), key="_row"), "judged")
    worded = judged.where("n_shingles > 0").select("_row", "kept")
    gone = cut(worded.where("NOT kept").select("_row").distinct(), "gone")
    again = cut(worded.where("kept").groupBy("_row").count().where("count > 1").select("_row"), "again")
    first = F.min(F.struct(*docs.columns)).alias("_first")
    one = same_rows(marked, again, "left_semi").groupBy("_row").agg(first).select("_first.*")
    return same_rows(marked, gone.unionByName(again), "left_anti").select(*docs.columns).unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and n_chars brought up to date."""
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (little-endian unsigned 32-bit integers) and the digest of the decoded bytes."""
    return encoded(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_dups", near_dups),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: The classifier's model and the tokens can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
