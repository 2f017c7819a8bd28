"""Query op11: all documents packed into sequences of at most 4096 tokens."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.common import table
from fathomline.llm.packing import pack, tokenize

TOKENIZER = "word_bpe_49k.json"


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    file = Path(public_tokenizers.path(TOKENIZER)).read_text(encoding="utf-8")
    pieces = tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), file)
    packed = pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", "sequence_id", "offset")


QUERIES = {"op11_packing": op11_packing}
ORACLES: dict[str, str] = {}
