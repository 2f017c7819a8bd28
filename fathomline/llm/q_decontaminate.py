"""Query op1: every document that contains a benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm.common import table
from fathomline.llm.decontaminate import find_contaminated


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


#: For items of five words or more.
_SQL = r"""
WITH cut AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents
), items AS (
  SELECT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM benchmark
), item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM items)
), doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM cut)
), sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id),
found AS (SELECT doc_id, item_id, count(*) AS k FROM doc_shingles JOIN item_shingles USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, k AS n_found, k / n AS containment
FROM found JOIN sizes USING (item_id) WHERE 100 * k >= 80 * n
"""

QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES = {"op1_decontaminate": _SQL}
