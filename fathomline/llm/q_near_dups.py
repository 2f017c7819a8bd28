"""Query op10: near duplicates among all documents, on 4-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm.common import LOWER, UPPER, table
from fathomline.llm.near_dups import near_duplicates


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), length=4, percent=80)


#: Shingles as strings, pairs that share one, and all that can be reached from a document.
SQL = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM split
), rows AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM rows x JOIN rows y ON x.g = y.g AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id, min(r.b) = s.doc_id AS kept
FROM sets s JOIN reached r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

QUERIES = {"op10_near_dups": op10_near_dups}
ORACLES = {"op10_near_dups": SQL}
