r"""Benchmark decontamination by size-partitioned MinHash containment search.

Words are runs of letters and digits, lower-cased.  A test item is the set of its distinct 5-word
shingles (all its words as one shingle if it has fewer).  A document contains an item if it has at
least 80 of 100 of the item's shingles, wherever they stand.

Search.  Containment in a long document can't be read from a sketch of the document, so the sketch
is the item's: its smallest shingle hashes.  Of n shingles a document may lack n - need, where
need = ceil(0.8 n); so of the item's n - need + 1 smallest hashes it has one at least, and a lookup
of these finds every document (no chance of a miss).  Items are dealt into partitions by size (powers
of two), by which the least document size of an item is known; no shingle above the largest sketch hash of
all partitions is looked up.  A document's shingles are hashed and looked up as they are generated,
row by row, and only hits leave the scan.

Verification.  Candidates get the exact intersection of both whole shingle sets, as strings.

The sketch table is broadcast if it has at most BROADCAST_ROWS rows (counted first), else joined by
shuffle; so are candidates.  Defined results: null texts are empty; items without a word are never
found; items with equal ids are items of their own and rows of equal (doc, item) are merged into
the best; null ids are kept and match null-safely; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import cut

SHINGLE = 5
CONTAINED = 80
#: About 16 MB of narrow rows.
BROADCAST_ROWS = 500_000


def plain_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingle_set(words: Column, length: Column | int) -> Column:
    """Distinct shingles of the given length, as strings."""
    length = F.lit(length) if isinstance(length, int) else length
    last = F.size(words) - length
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, length), " "))
    return F.array_distinct(F.when((last >= 0) & (length > 0), made).otherwise(F.array().cast("array<string>")))


def _hashes(words: Column, length: int) -> Column:
    """Hash of every shingle, in order."""
    last = F.size(words) - length
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(length)]))
    return F.when(last >= 0, made).otherwise(F.array().cast("array<bigint>"))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sketch_items(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, length (words a shingle), shingles, n, need, part (size partition) and sketch (hashes) of every item with a word."""
    cut_up = items.select(F.col(item).alias("item"), plain_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    sets = cut_up.withColumn("length", F.least(F.size("w"), F.lit(SHINGLE))).withColumn("shingles", _shingle_set(F.col("w"), F.col("length")))
    counted = sets.withColumn("n", F.size("shingles")).withColumn("need", F.ceil(F.col("n") * CONTAINED / 100).cast("int"))
    own = F.lit(None).cast("array<bigint>")
    for length in range(1, SHINGLE + 1):
        own = F.when(F.col("length") == length, _hashes(F.col("w"), length)).otherwise(own)
    hashes = F.sort_array(F.array_distinct(own))
    return counted.select(
        F.monotonically_increasing_id().alias("number"),
        "item",
        "length",
        "shingles",
        "n",
        "need",
        F.floor(F.log2("n")).cast("int").alias("part"),
        F.slice(hashes, F.lit(1), F.col("n") - F.col("need") + 1).alias("sketch"),
    )


def _hits(docs: DataFrame, index: DataFrame, length: int, most: int, rows: int) -> DataFrame:
    """doc, number: lookups of the documents' shingles of one length; most: the largest hash looked up."""
    # explode_outer: for explode Spark would add a filter that computes the hashes a second time
    low = F.filter(_hashes(F.col("w"), length), lambda h: h <= most)
    hashed = docs.select("doc", F.size("w").alias("doc_words"), F.explode_outer(low).alias("h"))
    own = index.where(F.col("length") == length)
    found = hashed.join(sized(own, rows), "h").where(F.col("doc_words") - length + 1 >= F.col("need"))
    return found.select("doc", "number").distinct()


def find_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item, n_shingles, n_found and containment for every document that contains an item."""
    sketched = cut(sketch_items(items, item, item_text), "items")
    index = sketched.select("number", "part", "length", "need", F.explode("sketch").alias("h"))
    # Per size partition and shingle length: the largest hash that any sketch holds.
    parts = index.groupBy("part", "length").agg(F.max("h").alias("most"), F.count(F.lit(1)).alias("rows")).collect()
    rows = sum(p["rows"] for p in parts)
    split = docs.select(F.col(key).alias("doc"), plain_words(F.col(text)).alias("w"))
    found = None
    for length in sorted({p["length"] for p in parts}):
        most = max(p["most"] for p in parts if p["length"] == length)
        some = _hits(split, index, length, most, rows)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = split.select("doc", F.lit(None).cast("long").alias("number")).where("false")
    candidates = cut(found, "candidates")
    n = candidates.count()

    c = sized(candidates.withColumnRenamed("doc", "wanted"), n)
    texts = docs.select(F.col(key).alias("doc"), F.col(text).alias("body")).join(c, F.col("doc").eqNullSafe(F.col("wanted"))).drop("wanted")
    exact = texts.join(sized(sketched.select("number", "item", "length", "shingles", "n", "need"), rows), "number")
    exact = exact.withColumn("w", plain_words(F.col("body")))
    both = F.size(F.array_intersect("shingles", _shingle_set(F.col("w"), F.col("length"))))
    verified = exact.select("doc", "number", "item", "n", "need", both.alias("n_found"))
    # The filter comes after the aggregation: pushed below it, Spark would split the text anew for every shingle.
    best = verified.groupBy("doc", "item").agg(F.max(F.struct((F.col("n_found") / F.col("n")).alias("share"), "n", "n_found", "need")).alias("b"))
    return best.where("b.n_found >= b.need").select(
        F.col("doc").alias(key),
        F.col("item").alias(item),
        F.col("b.n").cast("long").alias("n_shingles"),
        F.col("b.n_found").cast("long").alias("n_found"),
        F.col("b.share").alias("containment"),
    )


def identity(key: str = "doc_id", text: str = "text") -> Column:
    """What tells documents apart where ids repeat: the id and a hash of the text."""
    return F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("hash"))


def same_rows(marked: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """marked (with _row) with or without (how: left_semi, left_anti) the given ones (_row), which are counted before they are broadcast."""
    wanted = sized(rows.select(F.col("_row.id").alias("_id"), F.col("_row.hash").alias("_hash")), rows.count())
    return marked.join(wanted, F.col("_row.id").eqNullSafe(F.col("_id")) & (F.col("_row.hash") == F.col("_hash")), how)


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that contain an item; another text under the same id stays."""
    marked = docs.withColumn("_row", identity(key, text))
    found = find_contaminated(marked.select("_row", text), items, "_row", text).select("_row").distinct()
    return same_rows(marked, cut(found, "contaminated"), "left_anti").drop("_row")
