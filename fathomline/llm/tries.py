r"""Prefix trie of conversations by most-significant-digit radix partitioning and multikey quicksort.

Turns (role, text) are dictionary-encoded: distinct ones get dense ids in the order of role and
digest, and the texts themselves are never shuffled.  A conversation is then a row of ids (8 bytes a
turn), the key of a radix sort whose digit is one turn.  Equal conversations are first merged into
classes (least conv_id, count, digest of all conv_ids); a class of any size is read as blocks of
conv_ids in order, so no task holds it.

All classes start in the root's bucket.  In a round every bucket is split by the next turn.  A part that
weighs more than `local` turns, and has two classes at least, is a bucket of the next round and a node of the trie;
all other parts are local: each goes to one task, which finishes it by multikey quicksort on the
remaining turns, emitting a node for every distinct prefix as it recurses.  Sums over subtrees are
added up on the way back: in a task for its part, and for the few large buckets (at most total / local
in a round) on the driver, from one row a bucket.  Rounds are as deep as prefixes that large buckets share.

Defined results: null roles and texts are empty; rows with a null conv_id belong to no conversation;
turns are ordered by turn (null first), then role, then the digest of the text; repeated rows are turns
of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import cut, words

#: A part with at most so many turns is finished in one task.
LOCAL = 200_000
#: Conversation ids in a block of a class.
IDS_A_BLOCK = 4_000
NODES_A_BATCH = 50_000
NO_IDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def encode_turns(turns: DataFrame) -> DataFrame:
    """conv_id and seq, the array of its turns (id, words) in order; ids are dense and ordered by role and digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    keyed = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), F.size(words(text)).alias("words")
    )
    keyed = cut(keyed, "turns")
    entries = keyed.select("role", "digest").distinct().orderBy("role", "digest")
    dictionary = cut(entries.withColumn("id", F.monotonically_increasing_id()), "dictionary")
    coded = keyed.join(dictionary, ["role", "digest"])
    grouped = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("seq"))


def head_length(conv_id: Column) -> Column:
    """Turns taken from the first conversation of a block: crc32 of the decimal id, modulo 4."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("int")


def rebuild(convs: DataFrame, block: int = 20) -> DataFrame:
    """Each conversation with the first head_length turns of conversation conv_id - conv_id % block in place of its own."""
    base = F.col("conv_id") - F.col("conv_id") % block
    heads = convs.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("_base"), F.slice("seq", 1, 3).alias("_head"))
    met = convs.withColumn("_base", base).join(heads, "_base", "left")
    none = F.array().cast(convs.schema["seq"].dataType)
    h = head_length(F.col("conv_id"))
    own = F.when(F.size("seq") > h, F.slice("seq", h + 1, F.size("seq"))).otherwise(none)
    return met.select("conv_id", F.concat(F.slice(F.coalesce("_head", none), F.lit(1), h), own).alias("seq"))


def classes(convs: DataFrame) -> DataFrame:
    """One row for each distinct sequence: conv_id (least), n, ids, words and the digest of its conv_ids, ascending and comma-joined."""
    flat = convs.select("conv_id", F.col("seq.id").alias("ids"), F.col("seq.words").alias("words"))
    ordered = flat.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: list | None = None
        for batch in batches:
            out: list[list] = []
            for conv, ids, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids != key or not out or out[-1][1] >= IDS_A_BLOCK:
                    key = ids
                    out.append([conv, 0, ids, own, []])
                out[-1][1] += 1
                out[-1][4].append(str(conv))
            for row in out:
                row[4] = ",".join(row[4])
            yield _batch(out, BLOCK)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row, state = None, None, None
        for batch in batches:
            out = []
            for conv, n, ids, own, joined in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids != key:
                    if row:
                        out.append([*row, state.hexdigest()])
                    key, row, state = ids, [conv, 0, ids, own], hashlib.sha256()
                else:
                    state.update(b",")
                row[1] += n
                state.update(joined.encode())
            yield _batch(out, CLASS)
        if row:
            yield _batch([[*row, state.hexdigest()]], CLASS)

    shape = "conv_id bigint, n bigint, ids array<bigint>, words array<int>"
    made = ordered.mapInArrow(blocks, f"{shape}, joined string")
    return made.repartition("ids").sortWithinPartitions("ids", "conv_id").mapInArrow(digests, f"{shape}, ends string")


_IDS = [("conv_id", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int32()))]
BLOCK, CLASS = pa.schema([*_IDS, ("joined", pa.string())]), pa.schema([*_IDS, ("ends", pa.string())])


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


class _Nodes:
    """Nodes of one local part in the order of creation: a parent comes before its children."""

    def __init__(self, parent: int):
        self.above, self.conv, self.depth, self.up, self.n, self.words, self.ends = parent, [], [], [], [], [], []

    def add(self, conv: int, depth: int, up: int, n: int, words: int, ends: str) -> int:
        for column, value in zip((self.conv, self.depth, self.up, self.n, self.words, self.ends), (conv, depth, up, n, words, ends), strict=True):
            column.append(value)
        return len(self.conv) - 1

    def rows(self) -> tuple[list, ...]:
        count = len(self.conv)
        children, leaves = [0] * count, [0] * count
        saved = [(n - 1) * w for n, w in zip(self.n, self.words, strict=True)]
        for k in range(count - 1, -1, -1):
            leaves[k] = leaves[k] or 1
            if (up := self.up[k]) >= 0:
                children[up] += 1
                leaves[up] += leaves[k]
                saved[up] += saved[k]
        parents = [self.conv[up] if up >= 0 else self.above for up in self.up]
        return self.conv, self.depth, parents, self.n, children, leaves, saved, self.ends


def finish(rows: list[tuple], depth: int, parent: int) -> _Nodes:
    """The nodes below `parent` of classes (conv_id, n, ids, words, ends) that share their first `depth` turns and are longer, by multikey quicksort."""
    nodes = _Nodes(parent)
    open_parts = [(rows, depth, -1)]
    while open_parts:
        part, d, up = open_parts.pop()
        if len(part) == 1:  # nothing left to compare: the rest of the conversation is a chain
            conv, n, ids, own, ends = part[0]
            for k in range(d, len(ids)):
                up = nodes.add(conv, k + 1, up, n, own[k], ends if k + 1 == len(ids) else NO_IDS)
            continue
        pivot = part[len(part) // 2][2][d]
        less, equal, more = [], [], []
        for row in part:
            (less if (digit := row[2][d]) < pivot else more if digit > pivot else equal).append(row)
        open_parts += [(side, d, up) for side in (less, more) if side]
        ended = next((r[4] for r in equal if len(r[2]) == d + 1), NO_IDS)
        node = nodes.add(min(r[0] for r in equal), d + 1, up, sum(r[1] for r in equal), equal[0][3][d], ended)
        if longer := [r for r in equal if len(r[2]) > d + 1]:
            open_parts.append((longer, d + 1, node))
    return nodes


_NODES = pa.schema([*[(n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string()), ("top_of", pa.int64())])


def _finish_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local parts one after the other; rows come sorted by bucket and digit."""

    def emit(part: list[tuple], bucket: int, depth: int, parent: int) -> Iterator[pa.RecordBatch]:
        columns = finish(part, depth, parent).rows()
        tops = [bucket if d == depth + 1 else None for d in columns[1]]
        for at in range(0, len(tops), NODES_A_BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + NODES_A_BATCH], f.type) for c, f in zip((*columns, tops), _NODES, strict=True)], schema=_NODES)

    key, part = None, []
    for batch in batches:
        for bucket, digit, depth, parent, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (bucket, digit) != key:
                if part:
                    yield from emit(part, *about)
                key, part, about = (bucket, digit), [], (bucket, depth, parent)
            part.append(tuple(row))
    if part:
        yield from emit(part, *about)


def trie(seqs: DataFrame, local: int = LOCAL) -> DataFrame:
    """The nodes of all conversations (conv_id, seq: array of turns with id and words), as NODE says."""
    spark = seqs.sparkSession
    given = cut(classes(seqs), "classes")
    members = given.select(F.lit(0).cast("long").alias("bucket"), "*")
    top = given.agg(F.min("conv_id").alias("conv"), F.sum("n").alias("n")).first()
    if top["conv"] is None:
        return spark.createDataFrame([], NODE)
    big: dict[int, dict] = {0: {"conv_id": top["conv"], "depth": 0, "parent": None, "n_convs": top["n"], "words": 0}}
    active, depth, locals_ = [0], 0, []
    while active:
        digit = F.get("ids", F.lit(depth))
        parts = members.groupBy("bucket", digit.alias("digit")).agg(
            F.sum(F.size("ids") - depth).alias("weight"), F.count(F.lit(1)).alias("classes"), F.min("conv_id").alias("conv"), F.sum("n").alias("n"),
            F.first(F.get("words", F.lit(depth))).alias("words"), F.min("ends").alias("ends"),
        )
        parts = cut(parts, "parts")
        for row in parts.where("digit IS NULL").collect():  # at most one class of a bucket ends there
            big[row["bucket"]]["ends"] = row["ends"]
        for row in parts.where("digit IS NOT NULL").groupBy("bucket").count().collect():
            big[row["bucket"]]["n_children"] = row["count"]
        large = [(row, len(big) + k) for k, row in enumerate(parts.where((F.col("weight") > local) & (F.col("classes") > 1) & F.col("digit").isNotNull()).collect())]
        names = spark.createDataFrame([(b, big[b]["conv_id"]) for b in active], "bucket bigint, parent bigint")
        chosen = spark.createDataFrame([(row["bucket"], row["digit"], k) for row, k in large], "bucket bigint, digit bigint, child bigint")
        for row, k in large:
            big[k] = {"conv_id": row["conv"], "depth": depth + 1, "parent": row["bucket"], "n_convs": row["n"], "words": row["words"]}
        split = members.withColumn("digit", digit).where(F.col("digit").isNotNull())
        split = split.join(F.broadcast(chosen), ["bucket", "digit"], "left").join(F.broadcast(names), "bucket")
        split = cut(split.select("bucket", "digit", F.lit(depth).alias("depth"), "parent", "conv_id", "n", "ids", "words", "ends", "child"), "split")
        locals_.append(split.where("child IS NULL").drop("child"))
        members = split.where("child IS NOT NULL").select(F.col("child").alias("bucket"), "conv_id", "n", "ids", "words", "ends")
        active, depth = [k for _, k in large], depth + 1
    every = locals_[0]
    for more in locals_[1:]:
        every = every.unionByName(more)
    dealt = every.repartition("bucket", "digit").sortWithinPartitions("bucket", "digit")
    nodes = cut(dealt.mapInArrow(_finish_parts, f"{NODE}, top_of bigint"), "nodes")
    sums = nodes.where("top_of IS NOT NULL").groupBy("top_of").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    below = {row["top_of"]: row for row in sums.collect()}
    for k in sorted(big, reverse=True):  # children have larger numbers than their parents
        node = big[k]
        node["leaves"] = node.get("leaves", 0) + (below[k]["leaves"] if k in below else 0) or 1
        node["saved"] = node.get("saved", 0) + (below[k]["saved"] if k in below else 0) + (node["n_convs"] - 1) * node["words"]
        if (up := node["parent"]) is not None:
            big[up]["leaves"] = big[up].get("leaves", 0) + node["leaves"]
            big[up]["saved"] = big[up].get("saved", 0) + node["saved"]
    tops = [
        (n["conv_id"], n["depth"], None if n["parent"] is None else big[n["parent"]]["conv_id"], n["n_convs"], n.get("n_children", 0), n["leaves"], n["saved"], n.get("ends", NO_IDS))
        for n in big.values()
    ]
    return nodes.drop("top_of").unionByName(spark.createDataFrame(tops, T._parse_datatype_string(NODE)))
