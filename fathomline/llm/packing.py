r"""Best-fit packing of token pieces into sequences of a fixed capacity, by hierarchical residual packing.

`tokenize` encodes every whole text, adds the end id and cuts what is longer than a sequence into
pieces.  A word-level tokenizer never joins across white space, so a worker encodes each distinct
word once (through the library) and keeps a bounded memo of words.

`pack` packs pieces.  They are dealt out evenly at random, so every partition has about the same mix of
lengths, and each partition packs its own best-fit: longest first, each into the fullest sequence
with room, in chunks of BINS_A_CHUNK.  Nearly full sequences (fewer than NEARLY free tokens) are
emitted.  The underfull ones are then items themselves: they are dealt to fewer partitions and packed
best-fit again, and so on up a tree, until one partition is left or a round no longer lessens their
number (sequences more than half full can't be joined, so another round would change nothing).
A task never holds more than a chunk, and only underfull sequences move after the first deal.

`sequences` reads the packed ids together, one row a sequence.

Defined results: a null text is empty and gives one piece with the end id only; null keys and
repeated rows are kept, each row has pieces of its own; control strings of the vocabulary inside a
text are ordinary text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import array
import math
import os
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import cut, slices, worker_cache

CAPACITY = 4096
END = 1
#: Sequences with fewer free tokens are emitted.
NEARLY = 64
#: Sequences (pieces, at first) that a task packs at once, and pieces in them.
BINS_A_CHUNK, PIECES_A_CHUNK = 20_000, 400_000
#: Words after which a worker's memo changes generation, and words given to the tokenizer at once.
MEMO_WORDS, WORDS_A_CALL = 400_000, 4_000
#: Texts of a task are worked on in groups of about this many bytes: a word that occurs in all of a group is looked up once.
BYTES_A_SLICE = 6_000_000
#: ASCII punctuation; letters before this code point are letters to every library; combining marks that compose with a letter.
PUNCTUATION, LATIN_END, MARKS = string.punctuation, "\u0250", "[\u0300-\u036f]"
#: A round that leaves more than this share of its sequences is the last.
STALLED = 0.95

#: Byte-level vocabularies write a byte that isn't printable as the next free code point from 256.
BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b < 33 or 126 < b < 161 or b == 173)}


class WordIds:
    """Token ids of words, as little-endian unsigned 32-bit integers, by a tokenizer that lower-cases and drops white space."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.encode_special_tokens = True
        self.memo: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.model = self.tokenizer.model.tokenize

    def learn(self, words: list[str]) -> None:
        """Encode the words that the memo lacks; a letter and the punctuation after it are never one token, so these are learnt apart."""
        if len(self.memo) > MEMO_WORDS:
            self.older, self.memo = self.memo, {"": b""}
        memo, older, split, plain, others = self.memo, self.older, [], [], []
        for w in words:
            if w in memo:
                continue
            if (ids := older.get(w)) is not None:
                memo[w] = ids
                continue
            core = w.rstrip(PUNCTUATION)
            if core and core != w and core[-1].isalpha() and core[-1] < LATIN_END:
                split.append((w, core))
                new = [p for p in (core, w[len(core) :]) if p not in memo]
            else:
                new = [w]
            for p in new:
                memo[p] = b""
                (plain if p.isalpha() and p.islower() and max(p) < LATIN_END else others).append(p)
        for p in plain:  # letters alone are one piece, which goes to the model as it is
            memo[p] = array.array("I", [token.id for token in self.model(p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_SIGNS))]).tobytes()
        for k in range(0, len(others), WORDS_A_CALL):
            some = others[k : k + WORDS_A_CALL]
            for p, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                memo[p] = array.array("I", found.ids).tobytes()
        for w, core in split:
            memo[w] = memo[core] + memo[w[len(core) :]]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and each text's number of ids.

        A-Z are lower-cased first, which the tokenizer does too (after composing, so not in texts with combining marks); each
        distinct word is looked up once and the rest is copying.
        """
        lower = pc.ascii_lower(texts)
        marked = pc.match_substring_regex(texts, MARKS)
        words = pc.ascii_split_whitespace(pc.if_else(marked, texts, lower))
        coded = words.flatten().dictionary_encode()
        names, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self.learn(names)
        found = list(map(self.memo.__getitem__, names))
        ids = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        counts = sizes[index]
        upto = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat((np.cumsum(sizes) - sizes)[index] - upto[:-1], counts) + np.arange(upto[-1])
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])
        return ids[at], np.diff(upto[edges])


_tokenizers: dict[int, WordIds] = worker_cache()


def tokenize(docs: DataFrame, file: str, end: int = END, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length and ids (binary, little-endian unsigned 32-bit integers); file: the tokenizer's JSON text."""
    shipped, label = docs.sparkSession.sparkContext.broadcast(file), hash(file)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if label not in _tokenizers:
            _tokenizers.clear()
            _tokenizers[label] = WordIds(shipped.value)
        own = _tokenizers[label]
        for batch in batches:
            for part in slices(batch, 1, BYTES_A_SLICE):
                ids, counts = own.encode(part.column(1))
                row = np.repeat(np.arange(len(counts)), counts)
                tokens = np.full(len(ids) + len(counts), end, "<u4")  # each text's ids, and the end id after them
                tokens[np.arange(len(ids)) + row] = ids
                sizes = counts + 1
                pieces = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), pieces)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                lengths = np.minimum(sizes[owner] - number * capacity, capacity)
                offsets = np.concatenate([[0], np.cumsum(4 * lengths)]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(tokens)])
                columns = [part.column(0).take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(number * capacity, pa.int64()), pa.array(lengths, pa.int32()), binary]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "piece", "start", "length", "ids"])

    given = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return given.mapInArrow(work, f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start bigint, length int, ids binary")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each item: longest first, into the fullest sequence with room for it, else into a new one."""
    placed = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0  # bit r of rooms: there is a sequence with r free tokens
    for k, length in zip((order := np.argsort(-lengths, kind="stable")).tolist(), lengths[order].tolist(), strict=True):
        if fitting := rooms >> length:
            room = length + (fitting & -fitting).bit_length() - 1
            to = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, to, made = capacity, made, made + 1
        placed[k] = to
        if left := room - length:
            by_room[left].append(to)
            rooms |= 1 << left
    return placed


def _merge(held: list[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """One best-fit round over the sequences of some batches (fill, members)."""
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    fill, members = rows.column(0).to_numpy(), rows.column(1)
    sizes = pc.list_value_length(members).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    to = best_fit(fill, capacity)
    order = np.argsort(to, kind="stable")
    moved = sizes[order]
    picked = np.repeat(starts[order] - (np.cumsum(moved) - moved), moved) + np.arange(moved.sum())
    pieces = members.flatten().take(pa.array(picked))
    names = [f.name for f in pieces.type]
    lengths = pieces.field(names.index("length")).to_numpy()
    counts = np.bincount(to, weights=sizes).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(counts)])
    upto = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    offset = upto[:-1] - np.repeat(upto[edges[:-1]], counts)
    fields = [pa.array(offset, pa.int64()) if n == "offset" else pieces.field(n) for n in names]
    packed = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(fields, names=names))
    out = pa.RecordBatch.from_arrays([pa.array(upto[edges[1:]] - upto[edges[:-1]], pa.int32()), packed], names=["fill", "members"])
    for at in range(0, out.num_rows, 2000):
        yield out.slice(at, 2000)


def _round(bins: DataFrame, capacity: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = pieces = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            pieces += pc.sum(pc.list_value_length(batch.column(1))).as_py()
            if rows >= BINS_A_CHUNK or pieces >= PIECES_A_CHUNK:
                yield from _merge(held, capacity)
                held, rows, pieces = [], 0, 0
        if held:
            yield from _merge(held, capacity)

    return bins.mapInArrow(work, bins.schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, nearly: int = NEARLY) -> DataFrame:
    """The rows of pieces (any columns, with length from 1 to capacity) with sequence_id and offset."""
    given = cut(pieces, "pieces")
    names = [c for c in given.columns if c not in ("sequence_id", "offset")]
    one = F.struct(*[F.col(f"`{c}`") for c in names], F.lit(0).cast("long").alias("offset"))
    bins = given.select(F.col("length").cast("int").alias("fill"), F.array(one).alias("members"))
    bins = bins.sparkSession.createDataFrame([], _plain(bins.schema)).unionByName(bins)
    left, done, mixed = given.count(), [], False
    while True:
        tasks = math.ceil(left / BINS_A_CHUNK)
        packed = cut(_round(bins.repartition(max(tasks, 1)), capacity), "bins")
        full = F.col("fill") > capacity - nearly
        done.append(packed.where(full))
        bins = packed.where(~full)
        before, left = left, bins.count()
        if tasks <= 1 or not left or (mixed and left > STALLED * before):
            break
        mixed = True
    done.append(bins)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    numbered = every.withColumn("sequence_id", F.monotonically_increasing_id()).select("sequence_id", F.explode("members").alias("m"))
    return numbered.select(*[F.col(f"m.`{c}`") for c in names], "sequence_id", "m.offset")


def _plain(schema: T.StructType) -> T.StructType:
    """The schema with every field nullable, as Python tasks return it."""

    def loose(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(loose(kind.elementType), True)
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name, loose(f.dataType), True) for f in kind.fields])
        return kind

    return loose(schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary, all its pieces in order) and n_tokens; packed: what `pack` makes of pieces with their ids."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["ids"]))
    return parts.select("sequence_id", joined.alias("ids")).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
