r"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's set holds its distinct word shingles as 64-bit hashes (with fewer words than a shingle,
the whole sequence is one).  Documents with equal sets form a class; one signature stands for it.

Signatures have SYMBOLS symbols of 16 bits.  Similar sets (80 of 100) differ in 12.8 of 64 symbols
on average, with a deviation of 3.2; the join finds all pairs of signatures that differ in DISTANCE =
26 at most (a miss has a chance of some 1e-5 at the threshold and less above).  Signatures are split
into CHUNKS chunks of 4; by pigeonhole one chunk of such a pair has 26 // 16 = 1 error at most, so
each chunk is indexed under its four ways to leave one symbol out, and the pair meets in a bucket.

Links.  Exact copies are one class, so a bucket holds distinct texts; still it may hold a third of all.
Pairs are never listed within a group.  In a round every bucket names centres, its least members by
hash orders that all buckets share, and every member proposes itself to the nearest centre of another
component in all its buckets, if it is within the signature distance: one proposal a member.
Proposals are confirmed on full sets, components are contracted, and buckets that are one component
leave.  The first round takes all buckets.  Then buckets of up to SMALL members make all near pairs of
different components.  Larger ones go on in rounds with other centres as long as more than one proposal
in FEW is a link.  What members are left unsettled, such as documents that share a frequent passage only,
are joined exactly by prefix filtering: of n shingles, a set similar to another shares one at least of
its n - ceil(0.8 n) + 1 rarest, and frequent passages are not among the rarest.  Only pairs of different
components are looked at, and they are confirmed on full sets alone, so no link between different texts
is lost and no group is expanded into all its pairs.

Defined results: null and blank texts have empty sets and are linked with nothing; null ids may be
linked, but a component takes the least id that is not null; rows with equal ids are documents of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import cut, release, slices
from fathomline.llm.components import components

SYMBOLS, CHUNKS, DISTANCE = 64, 16, 26
PER_CHUNK = SYMBOLS // CHUNKS
SMALL = 8
#: Centres of a larger bucket in a round.  Rounds end once one proposal or less in FEW is a link; the prefix join has the rest.
CENTRES, FEW = 4, 20
#: Rows of a table sent to all workers: of two numbers each, and of signatures.
BROADCAST_ROWS, BROADCAST_SIGNATURES = 300_000, 30_000
MEMO = 200_000

_draw = np.random.default_rng(20240)
_MIX = _draw.integers(1, 2**63, 8, np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _draw.integers(0, 2**63, (SYMBOLS, 1), np.uint64) * np.uint64(2)
_MUL = _draw.integers(0, 2**63, (SYMBOLS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMO:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word)
        return got


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: bytes, length: int, memo: dict) -> np.ndarray:
    """Sorted distinct shingle hashes of a lower-cased text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.array(list(map(memo.__getitem__, words)), np.uint64)
    n = max(1, len(ids) - length + 1)
    h = np.full(n, len(words) if len(words) < length else 0, np.uint64)
    for k in range(min(length, len(ids))):
        h = _mixed(h + ids[k : k + n] * _MIX[k])
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        least = np.minimum(least, ((shingles[None, k : k + 4096] ^ _XOR) * _MUL).min(1))
    return (_mixed(least) & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16)


def _class_of(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), len(shingles))).view(np.int64))


def _body(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def sketch(docs: DataFrame, length: int, key: str, text: str) -> DataFrame:
    """id, n (set size), class (null if empty) and sig of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        memo = _WordHash()
        for batch in itertools.chain.from_iterable(slices(b, 1) for b in batches):
            sizes, classes, sigs = [], [], []
            for value in batch.column(1).to_pylist():
                s = shingle_set(value, length, memo)
                sizes.append(len(s))
                classes.append(_class_of(s) if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(sigs, pa.list_(pa.int16()))],
                names=["id", "n", "class", "sig"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), _body(text).alias("t")).mapInArrow(work, f"id {kind}, n bigint, class bigint, sig array<smallint>")


def full_sets(docs: DataFrame, length: int, text: str) -> DataFrame:
    """class, set (array of hashes) of every row with a word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        memo = _WordHash()
        for batch in itertools.chain.from_iterable(slices(b, 0) for b in batches):
            sets = [s for s in (shingle_set(v, length, memo) for v in batch.column(0).to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["class", "set"],
            )

    return docs.select(_body(text).alias("t")).mapInArrow(work, "class bigint, set array<bigint>")


def chunk_keys(sig: Column) -> Column:
    """The 64 bucket keys of a signature: chunk and omitted symbol in the top bits, three symbols below."""

    def key(number: Column) -> Column:
        chunk, out = F.floor(number / PER_CHUNK).cast("int"), number % PER_CHUNK
        packed = number.cast("long")
        for k in range(PER_CHUNK - 1):
            at = chunk * PER_CHUNK + k + (F.lit(k) >= out).cast("int")
            packed = packed * 65536 + F.get(sig, at)
        return packed

    return F.transform(F.sequence(F.lit(0), F.lit(CHUNKS * PER_CHUNK - 1)), key)


def _distance(one: Column, other: Column) -> Column:
    """Symbols in which two signatures differ."""
    return F.aggregate(F.zip_with(one, other, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def _maybe_broadcast(df: DataFrame, most: int | None = None) -> DataFrame:
    return F.broadcast(df) if df.count() <= (most or BROADCAST_ROWS) else df


class _Links:
    """Confirmation of candidate pairs on full sets, and the components of what is confirmed."""

    def __init__(self, docs: DataFrame, reps: DataFrame, length: int, percent: int, key: str, text: str):
        self.docs, self.reps, self.length, self.percent, self.key, self.text = docs, reps, length, percent, key, text
        #: class, label (least class of the component) of the classes that are linked; all others are their own.
        self.labels = self.sized_labels = reps.select("class", F.col("class").alias("label")).where("false")

    def signed(self, rows: DataFrame) -> DataFrame:
        """rows (with a class), the label and the signature of each."""
        return self.labelled(rows).join(self.reps.select("class", "sig"), "class")

    def labelled(self, rows: DataFrame) -> DataFrame:
        """rows (with a class) and the label of each."""
        return rows.join(self.sized_labels, "class", "left").withColumn("label", F.coalesce("label", F.col("class")))

    def sets(self, classes: DataFrame) -> DataFrame:
        """class, set of the wanted classes (distinct rows), from the texts of their representatives."""
        ids = cut(self.reps.join(classes, "class", "left_semi").select(F.col("id").alias("_id")), "ids")
        docs = self.docs.join(_maybe_broadcast(ids), self.docs[self.key].eqNullSafe(F.col("_id")), "left_semi")
        made = full_sets(docs.select(self.text), self.length, self.text).join(classes, "class", "left_semi")
        return cut(made.dropDuplicates(["class"]), "sets")

    def confirm(self, pairs: DataFrame, sets: DataFrame | None = None) -> int:
        """Link the pairs a, b whose sets are similar enough; the number of links."""
        pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        if pairs.isEmpty():
            return 0
        if sets is None:
            sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct())
        both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
        inter = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        union = F.size("set_a") + F.size("set_b") - inter
        links = cut(both.where(inter * 100 >= union * self.percent).select("a", "b"), "links")
        found = links.count()
        if found:
            self._contract(links)
        return found

    def _contract(self, links: DataFrame) -> None:
        """Components of the labels that links connect; each class gets its new label."""
        ends = self.labelled(links.select(F.col("a").alias("class"), "b")).select(F.col("label").alias("x"), F.col("b").alias("class"))
        ends = self.labelled(ends).select(F.greatest("x", "label").alias("a"), F.least("x", "label").alias("b")).where("a <> b")
        merged = cut(components(ends), "merged")
        known = self.labels.unionByName(merged.select(F.col("node").alias("class"), F.col("node").alias("label"))).distinct()
        new = known.join(_maybe_broadcast(merged.toDF("label", "new")), "label", "left")
        self.labels = cut(new.select("class", F.coalesce("new", "label").alias("label")), "labels")
        self.sized_labels = _maybe_broadcast(self.labels)


def shared_buckets(reps: DataFrame) -> DataFrame:
    """key, n, class of the members of buckets with two members or more; reps: class, sig."""
    keyed = reps.select("class", F.explode(chunk_keys(F.col("sig"))).alias("key"))
    buckets = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    return cut(keyed.join(_maybe_broadcast(buckets), "key"), "members")


def proposals(members: DataFrame, first: int, centres: int) -> tuple[DataFrame, DataFrame]:
    """Pairs a, b: every member with the nearest centre of another component, if that is near enough; and the members of unsettled buckets.

    members: key, n, class, sig, label; first: number of the first hash order.
    """
    this = F.struct("class", "label", "sig")
    orders = [F.min(F.struct(F.xxhash64(F.lit(first + k), "class").alias("h"), this.alias("c"))).getField("c") for k in range(centres)]
    buckets = members.groupBy("key").agg(F.min("label").alias("one"), F.max("label").alias("other"), F.array_distinct(F.array(*orders)).alias("centres"))
    buckets = cut(buckets.where("one <> other").select("key", "centres"), "open-buckets")
    met = members.join(_maybe_broadcast(buckets, BROADCAST_SIGNATURES // centres), "key")
    others = F.filter("centres", lambda c: c["label"] != F.col("label"))
    nearest = F.array_min(F.transform(others, lambda c: F.struct(_distance(F.col("sig"), c["sig"]).alias("d"), c["class"].alias("b"))))
    left = cut(met.select("key", "n", "class", nearest.alias("c")), "open")
    chosen = left.groupBy("class").agg(F.min("c").alias("c")).where(F.col("c.d") <= DISTANCE)
    return chosen.select(F.col("class").alias("a"), F.col("c.b").alias("b")), left.select("key", "n", "class")


def small_pairs(members: DataFrame) -> DataFrame:
    """a, b: all near pairs of different components in buckets of up to SMALL members; members: key, class, sig, label."""
    listed = members.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("class", "label", "sig"))).alias("m"))
    ahead = listed.select(F.explode(F.sequence(F.lit(0), F.size("m") - 1)).alias("k"), "m")
    pairs = ahead.select(F.get("m", F.col("k")).alias("x"), F.explode(F.slice("m", F.col("k") + 2, F.size("m"))).alias("y"))
    near = (F.col("x.label") != F.col("y.label")) & (_distance(F.col("x.sig"), F.col("y.sig")) <= DISTANCE)
    return pairs.where(near).select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))


def rare_pairs(labelled: DataFrame, percent: int) -> DataFrame:
    """a, b: every pair of sets of different components that may be similar, by prefix filtering; labelled: class, set, label."""
    rows = labelled.select("class", F.explode("set").alias("h"))
    common = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    ordered = rows.join(common, "h").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    n = F.size("s")
    kept = n - F.ceil(n * percent / 100).cast("int") + 1
    sliced = ordered.select("class", n.alias("n"), F.slice(F.col("s.h"), F.lit(1), kept).alias("rare")).join(labelled.select("class", "label"), "class")
    rare = cut(sliced, "rare")
    # Postings of shingles that two components share; only these carry what tells a pair's first shared one.
    postings = rare.select("label", F.explode("rare").alias("h"))
    mixed = cut(postings.groupBy("h").agg(F.min("label").alias("one"), F.max("label").alias("other")).where("one <> other").select("h"), "mixed")
    held = rare.select("class", F.posexplode("rare").alias("at", "h")).join(_maybe_broadcast(mixed), "h", "left_semi")
    held = held.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("at", "h"))).alias("m"))
    prefix = cut(rare.select("class", "n", "label").join(held, "class").select("class", "n", "label", F.col("m.h").alias("rare"), F.explode("m").alias("m")), "prefixes")
    prefix = prefix.select("class", "n", "label", "rare", "m.at", "m.h")
    other = prefix.select("h", *[F.col(c).alias(f"{c}_2") for c in ("class", "n", "rare", "at", "label")])
    # A pair counts at its first shared shingle only; sizes and what is left of both sets from there must allow the similarity.
    small, big = F.least("n", "n_2"), F.greatest("n", "n_2")
    most = F.least(F.col("n") - F.col("at"), F.col("n_2") - F.col("at_2"))
    first = F.get(F.array_intersect("rare", "rare_2"), F.lit(0)) == F.col("h")
    fits = first & (small * 100 >= big * percent) & (most * (100 + percent) >= (F.col("n") + F.col("n_2")) * percent)
    return prefix.join(other, "h").where((F.col("class") < F.col("class_2")) & (F.col("label") != F.col("label_2")) & fits).select(
        F.col("class").alias("a"), F.col("class_2").alias("b")
    )


def linked(docs: DataFrame, reps: DataFrame, length: int, percent: int, key: str, text: str) -> DataFrame:
    """class, label (least class of the component) of every class that has a link."""
    links = _Links(docs, reps, length, percent, key, text)
    members = shared_buckets(reps.select("class", "sig"))
    pairs, members = proposals(links.signed(members), 0, 1)
    links.confirm(pairs)
    links.confirm(small_pairs(links.signed(members.where(F.col("n") <= SMALL))))
    large = members.where(F.col("n") > SMALL)
    sets = links.sets(large.select("class").distinct())
    if sets.isEmpty():
        return links.labels
    first = 1
    while True:
        pairs, large = proposals(links.signed(large), first, CENTRES)
        first += CENTRES
        pairs = cut(pairs, "proposals")
        if links.confirm(pairs, sets) * FEW <= pairs.count():
            break
    rest = sets.join(large.select("class").distinct(), "class", "left_semi")
    links.confirm(rare_pairs(links.labelled(rest), percent), sets)
    return links.labels


def near_duplicates(docs: DataFrame, length: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (least key of the component) and kept (it is the document's own) of every document."""
    rows = cut(sketch(docs, length, key, text), "sketches")
    # Equal sets have equal signatures.
    reps = cut(rows.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("id"), F.first("sig").alias("sig")), "reps")
    labels = linked(docs, reps, length, percent, key, text)
    named = reps.select("class", "id").join(_maybe_broadcast(labels), "class", "left").withColumn("label", F.coalesce("label", F.col("class")))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    by_class = named.select("class", "label").join(least, "label").select("class", "component_id")
    out = rows.drop("sig").join(by_class, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
