"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt to blocks by a hash of their key.  A random matrix says how many rows of each
block go to each shard: row by row it is a draw from the multivariate hypergeometric law, so the
result is distributed as if all rows had been shuffled at once, while shard sizes are exact.
Within a block rows are put in random order (first permutation), cut as the matrix says, and
exchanged; within a shard they are put in random order again (second permutation), which numbers
the slots.  The text itself is never moved, only its key, size and checksum.

Defined results: a null text counts as empty; a null key is a key like any other; repeated rows
are rows of their own (equal rows are interchangeable); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block or of a slot bucket, on average; a task sorts about this many narrow rows.
ROWS_A_BLOCK = 250_000
LEAST_BLOCKS = 64


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among draws taken without replacement, by inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    at_mode = math.exp(_log_choose(good, mode) + _log_choose(bad, draws - mode) - _log_choose(good + bad, draws))
    left, up, down, p_up, p_down = rng.random() - at_mode, mode, mode, at_mode, at_mode
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if p_up + p_down == 0.0:
            break
    return mode


def communication_matrix(block_sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Counts of rows from each block to each shard; shard sizes differ by one at most."""
    rng, rows = random.Random(seed), sum(block_sizes)
    left = [rows // shards + (s < rows % shards) for s in range(shards)]
    matrix = []
    for size in block_sizes:
        rest, open_rows, line = size, sum(left), []
        for s in range(shards):
            n = hypergeometric(rng, left[s], open_rows - left[s], rest)
            open_rows -= left[s]
            rest -= n
            left[s] -= n
            line.append(n)
        matrix.append(line)
    return matrix


def _numbered(df: DataFrame, group: list[str], order: str, buckets: int) -> DataFrame:
    """Column rank: 0, 1, ... in each group by order (a random long), found from bucket counts and ranks within buckets."""
    bucketed = df.withColumn("_bucket", F.shiftrightunsigned(order, 1) % buckets)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy(*group, "_bucket").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy(*group, "_bucket").orderBy(order, "_tie")
    ranked = bucketed.withColumn("_inside", F.row_number().over(inside) - 1)
    return ranked.join(offsets, [*group, "_bucket"]).withColumn("rank", F.col("_before") + F.col("_inside")).drop("_bucket", "_before", "_inside")


def shuffle_to_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, seed: int = 7) -> DataFrame:
    """key, size (UTF-8 bytes + 16), text_crc32, shard and slot of every row; slots are gapless from 0 in each shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    total = docs.count()
    blocks = max(LEAST_BLOCKS, math.ceil(total / ROWS_A_BLOCK))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), "_key", "text_crc32"), F.lit(blocks)))
    counts = {r["_block"]: r["count"] for r in rows.groupBy("_block").count().collect()}  # one row a block
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], shards, seed)

    # First permutation: a random order in each block, cut where the matrix says.
    local = Window.partitionBy("_block").orderBy("_first", "_tie")
    rows = (
        rows.withColumn("_tie", F.struct("_key", "size", "text_crc32"))
        .withColumn("_first", F.xxhash64(F.lit(seed + 1), "_key", "text_crc32"))
        .withColumn("_rank", F.row_number().over(local))
    )
    cuts = docs.sparkSession.createDataFrame(
        [(b, [sum(line[: s + 1]) for s in range(shards)]) for b, line in enumerate(matrix)], "_block long, _cuts array<long>"
    )
    dealt = rows.join(cuts, "_block").withColumn("shard", F.size(F.filter("_cuts", lambda c: c < F.col("_rank"))))

    # Second permutation: a random order in each shard, which numbers the slots.
    dealt = dealt.withColumn("_second", F.xxhash64(F.lit(seed + 2), "_key", "text_crc32", "_rank"))
    slots = _numbered(dealt.drop("_cuts", "_block", "_first"), ["shard"], "_second", max(1, math.ceil(total / shards / ROWS_A_BLOCK)) * 8)
    return slots.select(F.col("_key").alias(key), "size", "text_crc32", "shard", F.col("rank").cast("long").alias("slot"))
