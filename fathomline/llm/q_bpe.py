"""Query op8: token ids of every document and what they decode to, as digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.bpe import encode_decode, read_ranks
from fathomline.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def encoded(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode_decode(docs, read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLES: dict[str, str] = {}
