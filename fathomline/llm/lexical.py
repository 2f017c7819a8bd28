r"""Ranked lexical search with variable-block-max WAND over sharded postings.

Terms are maximal runs of ASCII letters, digits and any character beyond ASCII, A-Z lower-cased.  The
score is an integer BM25 (weights and parts as in `weights` and `impacts`).

First pass: every document is tokenized once and kept as a short row, its length and the counts of
those of its terms that some query has; document counts by term, N and L are summed from these rows.
Second pass, by shards of SHARD_DOCS rows of a task: documents are put in an order that keeps those of a kind
together, and every term gets its postings in that order with their exact impacts.  A term's postings are cut
into blocks of variable size by dynamic programming over runs of postings, which minimises the bound
error (what the blocks' maxima overstate, over documents) plus a fixed cost a block; gaps between blocks
have the bound 0.  A query merges the block boundaries of its terms into intervals; the bound of an
interval is the sum of the blocks' maxima there.  The intervals with the largest bounds are read first and set the threshold;
then the cursor goes over the intervals in document order.  It skips all whose bound is below the
threshold without reading postings, and in the others reads only postings, adds impacts up and raises
the threshold.  A document that reaches the threshold is never skipped, ties included, so each shard's
answer is exact, and so is the merged one.

Queries are broadcast in blocks of about BLOCK_BYTES of their texts, so what is sent is bounded
whatever their number; each block is one pass over the short rows.

Defined results: a null text has no term; a query without terms finds nothing; equal scores are ranked
by ascending key, null keys last; repeated rows are ranked one by one; repeated queries are answered
one by one; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import cut, slices

TOP = 10
SHARD_DOCS = 20_000
#: Runs of a long posting list, runs in a block at most, and the mean impacts of bound error that another block has to save.
RUNS, LONGEST, BLOCK_COST = 2048, 64, 16.0
#: Intervals that are read at once: first those of the largest bounds, then by document order.
FIRST_READ, READ = 64, 2048
BLOCK_BYTES = 4_000_000
#: Terms of the queries beyond which the first pass keeps every term instead of sending them.
SENT_TERMS = 500_000

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def weights(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, weight: int, n_docs: int, total: int) -> np.ndarray:
    spread = 10 + (90 * length * n_docs) // total
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * spread))


def cut_blocks(doc: np.ndarray, score: np.ndarray, cost: float = BLOCK_COST, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks (first document, document after the last, maximum) of a posting list, with the least bound error.

    A block states its maximum for every document from its first to its last posting, and nothing for those between blocks.
    The error, over documents, is what is stated less what is there; each block adds `cost` mean impacts, so that it pays.
    Blocks hold whole runs: single postings of short lists, and of long ones so many that there are RUNS of them.
    """
    run = len(score) // RUNS + 1
    starts = np.arange(0, len(score), run)
    peaks = np.maximum.reduceat(score, starts).astype(np.float64)
    low, high = doc[starts].astype(np.float64), doc[np.append(starts[1:], len(doc)) - 1] + 1.0
    fixed = cost * float(score.mean())
    best, origin = np.zeros(len(starts) + 1), np.zeros(len(starts) + 1, np.int64)
    for end in range(1, len(starts) + 1):
        back = max(0, end - longest)
        highest = np.maximum.accumulate(peaks[back:end][::-1])[::-1]
        # what is there is the same for every cut, so it is left out
        tried = best[back:end] + highest * (high[end - 1] - low[back:end])
        at = int(tried.argmin())
        best[end], origin[end] = tried[at] + fixed, back + at
    edges, at = [], len(starts)
    while at:
        at = int(origin[at])
        edges.append(at)
    first = np.array(edges[::-1], np.int64)
    return low[first].astype(np.int64), high[np.append(first[1:], len(starts)) - 1].astype(np.int64), np.maximum.reduceat(peaks, first).astype(np.int64)


def reordered(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A new number for every document of a shard: by its most frequent term, then by length, so that blocks hold documents of a kind."""
    order = np.lexsort((term, -tf, doc))
    top = np.full(len(length), -1, np.int64)
    firsts = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
    top[doc[firsts]] = term[firsts]
    number = np.empty(len(length), np.int64)
    number[np.lexsort((length, top))] = np.arange(len(length))
    return number


class Shard:
    """Postings, in document order, of the rows of one shard."""

    def __init__(self, docs: int, term: np.ndarray, doc: np.ndarray, score: np.ndarray):
        self.docs = docs
        order = np.lexsort((doc, term))
        term, self.doc, self.score = term[order], doc[order], score[order]
        found, first = np.unique(term, return_index=True)
        self.span = dict(zip(found.tolist(), zip(first.tolist(), np.append(first[1:], len(term)).tolist(), strict=True), strict=True))
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def blocked(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if term not in self.blocks:
            low, high = self.span[term]
            self.blocks[term] = cut_blocks(self.doc[low:high], self.score[low:high])
        return self.blocks[term]

    def bounds(self, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Edges of the intervals that the blocks of some terms make, and the sum of the maxima in each."""
        lists = [self.blocked(t) for t in terms]
        edges = np.concatenate([*(b[0] for b in lists), *(b[1] for b in lists)])
        steps = np.concatenate([*(b[2] for b in lists), *(-b[2] for b in lists)])
        edges, which = np.unique(edges, return_inverse=True)
        change = np.zeros(len(edges), np.int64)
        np.add.at(change, which, steps)
        return edges, np.cumsum(change)[:-1]

    def read(self, terms: list[int], lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of some intervals [low, high) and their whole scores."""
        docs, scores = [], []
        for t in terms:
            low, high = self.span[t]
            own = self.doc[low:high]
            a, b = np.searchsorted(own, lows), np.searchsorted(own, highs)
            counts = b - a
            at = low + np.repeat(a - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            docs.append(self.doc[at])
            scores.append(self.score[at])
        found, which = np.unique(np.concatenate(docs), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, which, np.concatenate(scores))
        return found, total

    def search(self, terms: list[int], top: int) -> tuple[np.ndarray, np.ndarray, int]:
        """All documents that may be among the best `top` (every one that ties with the last of them too), their scores, intervals read."""
        terms = [t for t in terms if t in self.span]
        if not terms:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        edges, bound = self.bounds(terms)
        ends = edges[1:]
        threshold, docs, scores, reads = 1, np.empty(0, np.int64), np.empty(0, np.int64), 0

        def take(which: np.ndarray) -> None:
            nonlocal threshold, docs, scores, reads
            reads += len(which)
            more, own = self.read(terms, edges[which], ends[which])
            docs, scores = np.append(docs, more), np.append(scores, own)
            if len(scores) > top:
                threshold = max(threshold, int(np.partition(scores, -top)[-top]))
            docs, scores = docs[scores >= threshold], scores[scores >= threshold]

        first = np.sort(np.argpartition(-bound, min(FIRST_READ, len(bound)) - 1)[:FIRST_READ])
        take(first)
        bound[first] = 0
        cursor = 0
        while cursor < len(bound):
            window = slice(cursor, cursor + READ)
            if len(kept := np.flatnonzero(bound[window] >= threshold)):
                take(cursor + kept)
            cursor += READ
        return docs, scores, reads


def _short_rows(docs: DataFrame, wanted: set[bytes] | None, key: str, text: str) -> DataFrame:
    """key, n (terms with repeats), terms and tfs (those that are wanted) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in slices(batch, 1):
                sizes, names, counts = [], [], []
                for body in part.column(1).to_pylist():
                    every = terms_of(body)
                    sizes.append(len(every))
                    own = Counter(every if known is None else [t for t in every if t in known])
                    names.append(list(own))
                    counts.append(list(own.values()))
                arrays = [part.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "n", "terms", "tfs"])

    given = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    return given.mapInArrow(work, f"`{key}` {docs.schema[key].dataType.simpleString()}, n bigint, terms array<binary>, tfs array<bigint>")


def _query_terms(queries: DataFrame) -> DataFrame:
    """number, block and term of every query, each term once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(set(terms_of(t))) for t in batch.column(2).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(itertools.chain(*sets), pa.binary())], names=["number", "block", "term"])

    return queries.select("number", "block", "text").mapInArrow(work, "number bigint, block int, term binary")


def _best(rows: DataFrame, groups: list[str], key: str, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_last(key)))
    return rows.withColumn("rank", place).where(F.col("rank") <= top)


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", query: str = "item_id", query_text: str = "text") -> DataFrame:
    """query, rank (from 1), key and score of each query's best documents with a score above 0."""
    spark = docs.sparkSession
    numbered = queries.select(F.col(query).alias("item"), F.coalesce(F.col(query_text), F.lit("")).cast("binary").alias("text")).withColumn("number", F.monotonically_increasing_id())
    numbered = cut(numbered, "queries")
    size = numbered.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = size // BLOCK_BYTES + 1
    terms = cut(_query_terms(numbered.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int"))), "query-terms")
    distinct = terms.select("term").distinct()
    wanted = {bytes(r["term"]) for r in distinct.collect()} if distinct.count() <= SENT_TERMS else None
    rows = cut(_short_rows(docs, wanted, key, text), "short-rows")
    n_docs, total = rows.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = cut(terms.join(held, "term"), "weights")
    found = None
    for block in range(blocks):
        asked: dict[int, list[int]] = {}
        index: dict[bytes, tuple[int, int]] = {}
        for r in weighed.where(F.col("block") == block).select("number", "term", "df").toLocalIterator():
            at, _ = index.setdefault(bytes(r["term"]), (len(index), weights(n_docs, r["df"])))
            asked.setdefault(r["number"], []).append(at)
        if asked:
            some = cut(_search_block(rows, index, asked, n_docs, total, top, key), "found")
            found = some if found is None else found.unionByName(some)
    if found is None:
        found = spark.createDataFrame([], rows.select(F.lit(0).cast("long").alias("number"), key, F.lit(0).cast("long").alias("score")).schema)
    # Each group holds `top` rows a shard at most; groups of shards are cut to `top` before they meet.
    spread = _best(found.withColumn("part", F.pmod(F.xxhash64(key), F.lit(16))), ["number", "part"], key, top)
    best = _best(spread.drop("rank"), ["number"], key, top)
    return best.join(numbered.select("number", "item"), "number").select(F.col("item").alias(query), F.col("rank").cast("int"), key, "score")


def _search_block(rows: DataFrame, index: dict[bytes, tuple[int, int]], asked: dict[int, list[int]], n_docs: int, total: int, top: int, key: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((index, asked))

    def answer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        known, queries = sent.value
        table = pa.Table.from_batches(held)
        keys = table.column(0).combine_chunks()
        length = table.column(1).to_numpy()
        found = [known.get(t, (-1, 0)) for c in table.column(2).chunks for t in c.flatten().to_pylist()]
        number = np.array([f[0] for f in found], np.int64)
        weight = np.array([f[1] for f in found], np.int64)
        tf = np.concatenate([c.flatten().to_numpy() for c in table.column(3).chunks])
        doc = np.repeat(np.arange(len(length)), pc.list_value_length(table.column(2)).to_numpy())
        use = number >= 0
        scores = impacts(tf[use], length[doc[use]], weight[use], n_docs, total)
        place = reordered(doc[use], number[use], tf[use], length)
        row_at = np.argsort(place)
        shard = Shard(len(length), number[use], place[doc[use]], scores)
        docs, values, asked_by = [], [], []
        for q, own in queries.items():
            d, s, _ = shard.search(own, top)
            docs.append(d)
            values.append(s)
            asked_by.append(np.full(len(d), q, np.int64))
        at = row_at[np.concatenate(docs)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(asked_by)), keys.take(pa.array(at)), pa.array(np.concatenate(values))], names=["number", key, "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= SHARD_DOCS:
                yield answer(held)
                held, count = [], 0
        if count:
            yield answer(held)

    return rows.where(F.size("terms") > 0).mapInArrow(work, f"number bigint, `{key}` {rows.schema[key].dataType.simpleString()}, score bigint")
