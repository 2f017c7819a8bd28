"""Query op12: the prefix trie of all rebuilt conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm.common import cut, table
from fathomline.llm.tries import encode_turns, rebuild, trie


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = cut(encode_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "conversations")
    return trie(rebuild(convs))


# The checksum is taken bit by bit: after each byte come eight marks, and a mark shifts.
_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, sha256(text)) AS seq FROM turns GROUP BY conv_id
), heads AS (
  SELECT *, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
             lambda ch: [unicode(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 4 AS h
  FROM convs
), built AS (
  SELECT c.conv_id, list_concat(coalesce(b.seq, [])[1:c.h], c.seq[c.h + 1:]) AS seq
  FROM heads c LEFT JOIN convs b ON b.conv_id = c.base
), prefixes AS (
  SELECT conv_id, len(seq) AS turns, unnest(range(0, len(seq) + 1)) AS depth, seq FROM built
), nodes AS (
  SELECT seq[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         count(DISTINCT seq[depth + 1]) FILTER (turns > depth) AS n_children,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY seq[1:depth], depth
), own AS (
  SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) END AS saved FROM nodes
), above AS (
  SELECT path[1:d] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM own) GROUP BY path[1:d]
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, a.n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN above a ON a.path = n.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""

QUERIES = {"op12_conversation_trie": op12_conversation_trie}
ORACLES = {"op12_conversation_trie": _SQL}
