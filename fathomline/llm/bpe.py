"""Byte-level BPE encoding and decoding of the distinct words of each partition.

Texts are cut into words by the vocabulary's pattern.  A word's neighbouring pair of least rank, the leftmost of equal ones, is
merged until no pair can be; a bounded memo keeps what a worker has seen.  A word of LONG bytes or more (a run of one letter, say)
is merged with a heap instead, by the same rule, for searching all its pairs again after each merge would take the square of its
length.  Decoding puts the bytes of the tokens together.

Defined results: a null text is empty and has no tokens; repeated rows get equal results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import release, worker_cache

LONG = 256
MEMO_WORDS = 300_000
#: Texts of a task are worked on in groups of about this many characters.
CHARS_A_GROUP = 1_000_000
FIRST, SECOND = itemgetter(0), itemgetter(1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder of one worker process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def learn(self, texts: list[list[str]]) -> None:
        """Add the words of the texts that the memo lacks; words not used since the last change of generation go."""
        wanted = set().union(*texts)
        if len(self.memo) > MEMO_WORDS:
            self.older, self.memo = self.memo, {}
        new = wanted - self.memo.keys()
        again = new & self.older.keys()
        self.memo.update((w, self.older[w]) for w in again)
        for w in new - again:
            raw = w.encode("utf-8", "surrogatepass")
            ids = self.heap_merge(raw) if len(raw) >= LONG else self.merge(raw)
            self.memo[w] = struct.pack(f"<{len(ids)}I", *ids), b"".join(map(self.token.__getitem__, ids))

    def merge(self, word: bytes) -> list[int]:
        """Token ids of a word: the leftmost pair of least rank is merged until none can be."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        rank, never = self.ranks.get, 1 << 32
        parts = [word[k : k + 1] for k in range(len(word))]
        pairs = [rank(word[k : k + 2], never) for k in range(len(word) - 1)]
        while pairs and (least := min(pairs)) < never:
            k = pairs.index(least)
            parts[k] += parts.pop(k + 1)
            del pairs[k]
            if k < len(pairs):
                pairs[k] = rank(parts[k] + parts[k + 1], never)
            if k:
                pairs[k - 1] = rank(parts[k - 1] + parts[k], never)
        return [self.ranks[p] for p in parts]

    def heap_merge(self, word: bytes) -> list[int]:
        """The same merges for one long word: a heap of (rank, position) over a linked list."""
        parts = [bytes([b]) for b in word]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        alive = [True] * len(parts)
        heap: list[tuple[int, int, bytes]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < len(parts) and (rank := self.ranks.get(both := parts[k] + parts[after[k]])) is not None:
                heapq.heappush(heap, (rank, k, both))

        for k in range(len(parts)):
            offer(k)
        while heap:
            _, k, both = heapq.heappop(heap)
            if not alive[k] or after[k] >= len(parts) or parts[k] + parts[after[k]] != both:
                continue
            gone = after[k]
            parts[k], alive[gone], after[k] = both, False, after[gone]
            if after[k] < len(parts):
                before[after[k]] = k
            offer(k)
            offer(before[k])
        return [self.ranks[p] for p, here in zip(parts, alive, strict=True) if here]

    def run(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Token ids of each text as little-endian unsigned 32-bit integers, and the bytes they decode to."""
        cut = [self.split(t) for t in texts]
        self.learn(cut)
        ids, decoded = [], []
        for words in cut:
            found = list(map(self.memo.__getitem__, words))
            ids.append(b"".join(map(FIRST, found)))
            decoded.append(b"".join(map(SECOND, found)))
        return ids, decoded


_codecs: dict[tuple, Codec] = worker_cache()


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, token_ids (binary: little-endian unsigned 32-bit integers), n_tokens and decoded (binary) of every text."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)
    label = (len(ranks), hash(frozenset(list(ranks.items())[-100:])), pattern)
    key_type = docs.schema[key].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(_codecs)
        if label not in _codecs:
            _codecs.clear()
            _codecs[label] = Codec(shipped.value, pattern)
        codec = _codecs[label]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < CHARS_A_GROUP):
                    chars += len(texts[end])
                    end += 1
                ids, decoded = codec.run(texts[at:end])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(decoded, pa.binary())],
                    names=[key, "token_ids", "n_tokens", "decoded"],
                )
                at = end

    given = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return given.mapInArrow(work, f"`{key}` {key_type.simpleString()}, token_ids binary, n_tokens bigint, decoded binary")
