r"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model.

Model.  Tokens are all words `[^\x20\x09-\x0D]+` and an end mark, as 48-bit hashes; a word that repeats the
one before it is a repetition.  The model is fitted on one half, by hash, of every language's labelled good documents; the
other half gives the limits, which need texts that the model has not seen.  Neither half is bounded.
Counts stay in Spark, sharded by context: counts of counts give the discounts of each
order, joins of the count tables the probability of every n-gram and the back-off weight of every
context.  Bigrams and trigrams whose count is below PRUNED_BELOW are pruned: their mass goes to the back-off weight.

Counting.  An n-gram seen twice has only parts seen twice, so a filter of these tells workers which longer n-grams
to count; what was seen once isn't held, for how often that was is what the counts of its parts leave.

Scoring.  log p(w | u, v) is a sum of terms, one of w, one of (v, w) and one of (u, v, w), each 0 where the model has no such n-gram.
So a document's log-probability is the sum of a table's values over its n-grams.  The table is dealt by hash into
sets of WAYS slots, SLOTS in all.  The WAYS most frequent n-grams of every set go to every worker and are added there.  All others are
joined by n-gram, sharded by hash: a filter of FILTER_BITS bits an n-gram tells workers which n-grams can be in
that part of the table, so only these leave them, and no frequent n-gram is ever a join key.

Decision.  Perplexities are drawn towards the trusted mean of the language by PRIOR_TOKENS tokens, so that
a short text isn't judged by a few words.  A document is rejected if it lies above the language's QUANTILE by
over MARGIN of log10 perplexity.  Means and quantiles cover all trusted documents that the model was not
fitted on, in bins of log10 perplexity, and are drawn towards those of all languages by PRIOR_DOCUMENTS
documents.

Defined results: a null or blank text has the end mark alone; a null language is a language like any
other; labels that contradict each other count as trusted only if all say good and none toxic; without
trusted documents everything is kept; rows that are equal in key, text and language are judged alike; an
empty table gives an empty result; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import collected, cut, slices, worker_cache
from fathomline.llm.decontaminate import sized

#: None: the model is fitted on half of all trusted documents; a number: on about so many at most.
TRUSTED_DOCUMENTS: int | None = None
#: What was seen once is pruned; the counting below rests on it.
PRUNED_BELOW = 2
SLOTS, SLOTS_A_BLOCK = 1 << 20, 1 << 16
#: A set's slots: an n-gram finds a place unless so many of its set are more frequent.
WAYS = 8
#: Counts from here on are not told apart when the least count with a rank is sought.
RANKED_BELOW = 10_000
#: The filter has 2**MOST_BITS bits at most (16 MB); in a fuller one more n-grams leave the workers in vain.
FILTER_BITS, MOST_BITS, PROBES = 16, 27, 3
QUANTILE, MARGIN = 0.995, 0.15
PRIOR_DOCUMENTS, PRIOR_TOKENS = 100, 20
#: Bins of log10 perplexity per unit; a limit is the upper edge of its bin.
BINS = 10_000
MEMO = 200_000
PARTIAL = 300_000
FILTER_BLOCK = 1 << 16

#: Hashes of the marks; REPEAT: the word before once more; REPEATS: the third time or later.
START, END, REPEAT, REPEATS = 1, 2, 3, 4
_MUL = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


class Ids(dict):
    """Word (bytes) to its hash; up to MEMO words are remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMO:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word) >> 16
        return got

    def of(self, text: bytes) -> np.ndarray:
        """Two start marks, the words, the end mark."""
        words = text.split()
        ids = np.empty(len(words) + 3, np.uint64)
        ids[:2], ids[-1] = START, END
        ids[2:-1] = list(map(self.__getitem__, words))
        if len(words) > 1:
            same = np.fromiter(map(eq, words, words[1:]), bool, len(words) - 1)
            if same.any():
                ids[3:-1][same] = REPEAT
                ids[4:-1][same[1:] & same[:-1]] = REPEATS
        return ids


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def grams(*ids: np.ndarray) -> np.ndarray:
    """Keys of the n-grams whose words are given in order, by order of the model."""
    h = np.full(len(ids[0]), len(ids), np.uint64)
    for part, mul in zip(ids, _MUL, strict=False):
        h = _mixed(h * mul + part)
    return h


def _keys(ids: np.ndarray) -> list[np.ndarray]:
    return [grams(ids[1:]), grams(ids[:-1], ids[1:]), grams(ids[:-2], ids[1:-1], ids[2:])]


def _body(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids that every label calls good and none toxic."""
    toxic = F.coalesce(F.max("toxic"), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("least"), toxic.alias("worst"))
    return good.where("least = 1 AND worst = 0").select("doc_id")


def fitted_ids(trusted: DataFrame, most: int | None = None) -> DataFrame:
    """Half of every language of trusted (doc_id, lang) by hash; with a bound about `most` in all, at most equally many of every language."""
    left = most or TRUSTED_DOCUMENTS or float("inf")
    counts = cut(trusted.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / 2).alias("n"), F.count(F.lit(1)).alias("docs")), "languages")
    # Distinct counts are few: their sum is at most the number of documents.
    sizes = [(r["n"], r["languages"]) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("languages")).orderBy("n").collect()]
    languages, share = sum(k for _, k in sizes), 1.0
    for n, k in sizes:
        share = left / languages
        if n > share:
            break
        left, languages, share = left - n * k, languages - k, float(n)
    rates = counts.select(F.col("lang").alias("_lang"), (F.least(F.lit(share), F.col("n")) / F.col("docs")).alias("_rate"))
    rated = trusted.join(sized(rates, sum(k for _, k in sizes)), F.col("lang").eqNullSafe(F.col("_lang")))
    return rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("_rate") * (1 << 30)).select("doc_id").distinct()


class Counts(NamedTuple):
    """words: w, seen; pairs: v, w, seen and trigrams: u, v, w, n of those seen PRUNED_BELOW times or more."""

    words: DataFrame
    pairs: DataFrame
    trigrams: DataFrame


def _counted(fitted: DataFrame, names: str, text: str, parts_in=lambda rows: slice(None)) -> DataFrame:
    """Ids by name, n of the n-grams that end in a word or the end; parts_in: which rows may be seen PRUNED_BELOW times."""
    size = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = Ids(), [], 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                s = ids.of(value)
                parts.append(np.stack([s[3 - size + k : len(s) + 1 - size + k] for k in range(size)], 1))
                held += len(parts[-1])
                if held >= PARTIAL:
                    yield summed(parts)
                    parts, held = [], 0
        if parts:
            yield summed(parts)

    def summed(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        rows = rows[parts_in(rows)].view(np.int64)
        rows = rows[np.lexsort(rows.T)]
        starts = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(1)][: len(rows)])
        n = np.diff(np.r_[starts, len(rows)])
        return pa.RecordBatch.from_arrays([*(pa.array(rows[starts, k]) for k in range(size)), pa.array(n, pa.int64())], names=[*names, "n"])

    fields = ", ".join(f"{c} bigint" for c in [*names, "n"])
    return fitted.select(_body(text)).mapInArrow(count, fields).groupBy(*names).agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, names: str):
    """Whether n-grams (columns of ids) may be among counts, by a filter that goes to the workers."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = grams(*(b.column(k).to_numpy().view(np.uint64) for k in range(len(names))))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    bits = filter_bits(counts.count())
    shipped = counts.sparkSession.sparkContext.broadcast(bit_filter(counts.select(*names).mapInArrow(keyed, "key bigint"), bits))

    def known(*ids: np.ndarray) -> np.ndarray:
        key, marked, out = grams(*ids), shipped.value, np.ones(len(ids[0]), bool)
        for k in range(PROBES):
            bit = probe(key, k, bits)
            out &= (marked[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
        return out

    return known


def trigram_counts(fitted: DataFrame, text: str = "text") -> Counts:
    """Counts of the fitted documents; words and pairs before a trigram's last word tell whether it can be seen more than once."""
    words = cut(_counted(fitted, "w", text).withColumnRenamed("n", "seen"), "words")
    word = _frequent(words.where(F.col("seen") >= PRUNED_BELOW), "w")
    pairs = _counted(fitted, "vw", text, lambda rows: ((rows[:, 0] == START) | word(rows[:, 0])) & word(rows[:, 1]))
    pairs = cut(pairs.where(F.col("n") >= PRUNED_BELOW).withColumnRenamed("n", "seen"), "pairs")
    pair = _frequent(pairs, "vw")
    trigrams = _counted(fitted, "uvw", text, lambda rows: ((rows[:, 1] == START) | pair(rows[:, 0], rows[:, 1])) & pair(rows[:, 1], rows[:, 2]))
    return Counts(words, pairs, cut(trigrams.where(F.col("n") >= PRUNED_BELOW), "trigrams"))


def _discounts(counts: DataFrame, once: int = 0) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more; once: n-grams seen once that counts lack."""
    c = [float(x or 0) for x in counts.agg(*[F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]).first()]
    c[0] += once
    y = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.5
    # Few counts may give a discount of nothing, which would leave unseen words no probability.
    return [min(k, max(0.1, k - (k + 1) * y * c[k] / c[k - 1])) if c[k - 1] else max(0.1, y) for k in (1, 2, 3)]


def _weights(counts: DataFrame, context: list[str], totals: DataFrame, d: list[float], least: int) -> DataFrame:
    """context, total and weight (the back-off: what discounts and pruned n-grams leave) of every context of totals (context, tokens); counts: n, seen by context and w.

    Tokens that counts don't hold are n-grams seen once.
    """
    discount = F.when(F.col("n") < least, F.col("n")).when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    held = counts.groupBy(*context).agg(F.sum("n").alias("_n"), F.sum(discount).alias("_held"), F.sum("seen").alias("_seen"))
    met = totals.join(held, context, "left").withColumn("_once", F.col("tokens") - F.coalesce("_seen", F.lit(0)))
    total, left = (F.col("_once") + F.coalesce(c, F.lit(0)) for c in ("_n", "_held"))
    return met.select(*context, total.alias("total"), (left / total).alias("weight"))


def _probability(d: list[float]) -> Column:
    """p of a seen n-gram, interpolated with p_low."""
    discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    return F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("p_low")


class Model:
    """values: key, value, n of every n-gram; unknown: log10 probability of a word that the model hasn't seen."""

    def __init__(self, counts: Counts):
        trigrams = counts.trigrams
        none, start = F.lit(0), F.lit(START).cast("long")
        tokens, documents = counts.words.agg(F.sum("seen"), F.sum(F.when(F.col("w") == END, F.col("seen")))).first()
        tokens, documents = int(tokens or 0), int(documents or 0)
        held3, held2 = (int(c.agg(F.sum(n)).first()[0] or 0) for c, n in ((trigrams, "n"), (counts.pairs, "seen")))
        # n: how many words stand before; those that trigrams lack are one for each token.
        several = trigrams.groupBy("v", "w").agg(F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_seen"))
        n = F.col("seen") - F.coalesce("_seen", none) + F.coalesce("_n", none)
        bigrams = cut(counts.pairs.join(several, ["v", "w"], "left").select("v", "w", n.alias("n"), "seen"), "bigrams")
        several = bigrams.groupBy("w").agg(F.count(F.lit(1)).alias("_n"), F.sum("seen").alias("_seen"))
        unigrams = cut(counts.words.join(several, "w", "left").select("w", n.alias("n"), "seen"), "unigrams")
        words = unigrams.count()
        d1, d2, d3 = _discounts(unigrams), _discounts(bigrams, tokens - held2), _discounts(trigrams, tokens - held3)
        discount = F.when(F.col("n") == 1, d1[0]).when(F.col("n") == 2, d1[1]).otherwise(d1[2])
        w1 = unigrams.agg(F.sum("n").alias("total"), (F.sum(discount) / F.sum("n")).alias("weight"))
        # How often a context was before a token: as often as it was seen, but for the end; the starts once a document.
        spark = trigrams.sparkSession
        first = spark.range(1 if documents else 0)
        totals = counts.words.where(F.col("w") != END).select(F.col("w").alias("v"), F.col("seen").alias("tokens")).unionByName(first.select(start.alias("v"), F.lit(documents).cast("long").alias("tokens")))
        w2 = cut(_weights(bigrams, ["v"], totals, d2, PRUNED_BELOW), "contexts1")
        # Contexts of which all n-grams are pruned have a back-off weight of 1.
        totals = bigrams.select(F.col("v").alias("u"), F.col("w").alias("v"), F.col("seen").alias("tokens")).unionByName(first.select(start.alias("u"), start.alias("v"), F.lit(documents).cast("long").alias("tokens")))
        w3 = cut(_weights(trigrams.withColumn("seen", F.col("n")), ["u", "v"], totals, d3, PRUNED_BELOW).where("weight < 1"), "contexts2")
        own = w1.first()["weight"]
        self.unknown = float(np.log10((own if words else 1.0) / (words + 1)))
        one = unigrams.crossJoin(F.broadcast(w1)).withColumn("p_low", F.lit(1.0 / (words + 1))).select("w", _probability(d1).alias("p"), "seen")  # one row of totals
        two = bigrams.where(F.col("n") >= PRUNED_BELOW).join(w2, "v").join(one.select("w", F.col("p").alias("p_low")), "w")
        two = cut(two.select("v", "w", _probability(d2).alias("p"), "p_low", "weight", "seen"), "kn2")
        three = trigrams.where(F.col("n") >= PRUNED_BELOW).join(w3, ["u", "v"]).withColumnsRenamed({"total": "total3", "weight": "weight3"})
        three = three.join(two.select("v", "w", F.col("p").alias("p2")), ["v", "w"], "left").join(w2, "v").join(one.select("w", F.col("p").alias("p1")), "w")
        three = three.select("u", "v", "w", "n", F.col("total3").alias("total"), F.coalesce("p2", F.col("weight") * F.col("p1")).alias("p_low"), F.col("weight3").alias("weight"))
        three = three.select("u", "v", "w", _probability(d3).alias("p"), "weight", "p_low", "n")
        log = F.log10
        after_one = w2.select(F.col("v").alias("w"), log("weight").alias("back"))
        after_two = w3.select(F.col("u").alias("v"), F.col("v").alias("w"), log("weight").alias("back"))
        nothing = F.lit(0.0)
        v1 = one.join(after_one, "w", "full").select(
            F.lit(None).cast("long").alias("u"), F.lit(None).cast("long").alias("v"), "w",
            (F.coalesce(log("p") - self.unknown, nothing) + F.coalesce("back", nothing)).alias("value"), F.coalesce("seen", F.lit(1 << 40)).alias("n"),
        )
        v2 = two.select("v", "w", (log("p") - log("weight") - log("p_low")).alias("own"), "seen").join(after_two, ["v", "w"], "full").select(
            F.lit(None).cast("long").alias("u"), "v", "w", (F.coalesce("own", nothing) + F.coalesce("back", nothing)).alias("value"), F.coalesce("seen", F.lit(1 << 40)).alias("n")
        )
        v3 = three.select("u", "v", "w", (log("p") - log("weight") - log("p_low")).alias("value"), "n")

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                u, v, w = (b.column(k) for k in range(3))
                ids = [np.asarray(c.fill_null(0)).view(np.uint64) for c in (u, v, w)]
                order = np.where(np.asarray(u.is_valid()), 3, np.where(np.asarray(v.is_valid()), 2, 1))
                key = np.choose(order - 1, [grams(ids[2]), grams(*ids[1:]), grams(*ids)])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(3), b.column(4)], names=["key", "value", "n"])

        self.values = v1.unionByName(v2).unionByName(v3).select("u", "v", "w", F.col("value").cast("float"), "n").mapInArrow(keyed, "key bigint, value float, n bigint")


class Tables:
    """What workers hold (slots' keys, values and further columns, the filter of the rest), and the rest of the table (key, value, further columns)."""

    def __init__(self, model: Model, kind: type = np.float32, more: tuple[str, ...] = (), slots_for: Callable[[int], int] | None = None):
        columns = {"key": np.int64} | dict.fromkeys(("value", *more), kind)
        values, slots, least = model.values.select(*columns, "n"), SLOTS, 0
        if slots_for:
            values = cut(values, "values")
            # Counts so low that the slots are filled without them need no rank.
            counts = values.groupBy(F.least("n", F.lit(RANKED_BELOW)).alias("n")).count().orderBy(F.desc("n")).collect()
            upto = np.cumsum([0, *(r["count"] for r in counts)])
            slots = slots_for(int(upto[-1]))
            least = next((r["n"] for r, many in zip(counts, upto[1:], strict=True) if many >= 2 * slots), 0)
        ways = min(WAYS, slots)
        of_set = F.pmod(F.col("key"), F.lit(slots // ways))
        ranked = values.where(F.col("n") >= least) if least else values
        ranked = ranked.withColumn("at", F.row_number().over(Window.partitionBy(of_set).orderBy(F.desc("n"), "key")))
        slot = F.when(F.col("at") <= ways, of_set * ways + F.col("at") - 1)
        table = cut(ranked.select(*columns, slot.alias("slot")), "slots")
        self.unknown = model.unknown
        held = {c: np.zeros(slots, of) for c, of in columns.items()}

        def packed(frame: pd.DataFrame) -> pd.DataFrame:
            at = frame["slot"].to_numpy()
            out = {"block": [at[0] // SLOTS_A_BLOCK]}
            for c, of in columns.items():
                part = np.zeros(SLOTS_A_BLOCK, of)
                part[at % SLOTS_A_BLOCK] = frame[c]
                out[c] = [part.tobytes()]
            return pd.DataFrame(out)

        fields = ", ".join(f"{c} binary" for c in columns)
        heads = table.where("slot IS NOT NULL").groupBy(F.floor(F.col("slot") / SLOTS_A_BLOCK)).applyInPandas(packed, f"block bigint, {fields}")
        for row in heads.toLocalIterator():  # SLOTS n-grams at most
            at = row["block"] * SLOTS_A_BLOCK
            for c, of in columns.items():
                part = np.frombuffer(row[c], of)
                held[c][at : at + len(part)] = part[: slots - at]
        self.keys, self.values, self.more = held["key"], held["value"], {c: held[c] for c in more}
        self.keys[:ways][self.keys[:ways] == 0] = 1  # empty slots of set 0 have no key of their own: 1 is of set 1
        self.rest = table.where("slot IS NULL").select(*columns)
        if least:
            self.rest = self.rest.unionByName(values.where(F.col("n") < least).select(*columns))
        self.bits = filter_bits(self.rest.count())
        self.filter = bit_filter(self.rest.select("key"), self.bits)


def look_up(keys: np.ndarray, values: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the found keys have a slot, and their values (0 for the others)."""
    ways = min(WAYS, len(keys))
    at, left = (found & np.int64(len(keys) // ways - 1)) * ways, np.arange(len(found))
    hit, value = np.zeros(len(found), bool), np.zeros(len(found), values.dtype)
    for _ in range(ways):
        same = keys[at] == found[left]
        of = left[same]
        hit[of], value[of] = True, values[at[same]]
        at, left = at[~same] + 1, left[~same]
    return hit, value


def filter_bits(keys: int) -> int:
    return 1 << min(MOST_BITS, max(16, int(keys * FILTER_BITS).bit_length()))


def bit_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A bit for each probe of each key, as bytes."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for at in (probe(b.column(0).to_numpy().view(np.uint64), k, bits) for k in range(PROBES)):
                np.bitwise_or.at(marked, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        for k in range(0, len(marked), FILTER_BLOCK):
            part = marked[k : k + FILTER_BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["at", "part"])

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.bitwise_or.reduce([np.frombuffer(p, np.uint8) for p in frame["part"]])
        return pd.DataFrame({"at": [frame["at"].iloc[0]], "part": [out.tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    for row in collected(keys.mapInArrow(mark, "at bigint, part binary").groupBy("at").applyInPandas(joined, "at bigint, part binary")):
        part = np.frombuffer(row["part"], np.uint8)
        out[row["at"] : row["at"] + len(part)] = part
    return out


def probe(keys: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The bit of the k-th probe of each key."""
    return (_mixed(keys * _MUL[k] + np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64)


_loaded: dict[str, tuple] = worker_cache()


def log_probabilities(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang, text_hash, n_tokens (words and the end) and log10 (of the text's probability) of every row."""
    tables = Tables(model)
    shipped, name = docs.sparkSession.sparkContext.broadcast((tables.keys, tables.values, tables.filter, tables.bits)), uuid.uuid4().hex
    unknown = tables.unknown

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:
            _loaded.clear()
            _loaded[name] = shipped.value
        own_keys, own_values, marked, bits = _loaded[name]
        ids = Ids()
        for batch in itertools.chain.from_iterable(slices(b, 3) for b in batches):
            rows = [ids.of(value) for value in batch.column(3).to_pylist()]
            n_tokens = np.array([len(r) - 2 for r in rows])
            total = n_tokens * unknown
            doc = np.arange(len(rows))
            lists = []
            parts = [_keys(r) for r in rows]
            for order in range(3):
                found = np.concatenate([p[order] for p in parts]).view(np.int64)
                where = np.repeat(doc, [len(p[order]) for p in parts])
                hit, value = look_up(own_keys, own_values, found)
                total = total + np.bincount(where[hit], value[hit], len(rows))
                left, where = found[~hit].view(np.uint64), where[~hit]
                for k in range(PROBES):
                    place = probe(left, k, bits)
                    maybe = (marked[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                    left, where = left[maybe], where[maybe]
                lists.append((where, left.view(np.int64)))
            where, rest = np.concatenate([w for w, _ in lists]), np.concatenate([k for _, k in lists])
            order = np.argsort(where, kind="stable")
            edges = np.searchsorted(where[order], np.arange(len(rows) + 1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array(n_tokens, pa.int64()), pa.array(total, pa.float64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(rest[order]))],
                names=["doc_id", "lang", "text_hash", "n_tokens", "log10", "rest"],
            )

    kinds = [docs.schema[c].dataType.simpleString() for c in (key, lang)]
    given = docs.select(F.col(key), F.col(lang), F.xxhash64(text), _body(text))
    scored = given.mapInArrow(work, f"doc_id {kinds[0]}, lang {kinds[1]}, text_hash bigint, n_tokens bigint, log10 double, rest array<bigint>")
    scored = cut(scored.withColumn("_row", F.monotonically_increasing_id()), "scores")
    joined = scored.select("_row", F.explode("rest").alias("key")).join(tables.rest, "key").groupBy("_row").agg(F.sum("value").alias("more"))
    return scored.drop("rest").join(joined, "_row", "left").withColumn("log10", F.col("log10") + F.coalesce("more", F.lit(0.0))).drop("_row", "more")


def _shrunk(mean: Column) -> Column:
    """log10 perplexity, drawn towards the trusted mean."""
    return (-F.col("log10") + PRIOR_TOKENS * mean) / (F.col("n_tokens") + PRIOR_TOKENS)


def _limit(known: DataFrame, by: list[str]) -> DataFrame:
    """by, mean, docs and limit (the quantile) of trusted scores."""
    means = known.groupBy(*by).agg((-F.sum("log10") / F.sum("n_tokens")).alias("mean"), F.count(F.lit(1)).alias("docs"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    named = means.select(*[F.col(c).alias(f"_{c}") for c in by], "mean", "docs")
    named = cut(named, "means")
    rows = known.join(sized(named, named.count()), same) if by else known.crossJoin(F.broadcast(named))  # without by: one row
    binned = rows.groupBy(*by, "mean", "docs", F.ceil(_shrunk(F.col("mean")) * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = binned.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("bin")))  # bins bound a language's rows
    return upto.where(F.col("upto") >= F.lit(QUANTILE) * F.col("docs")).groupBy(*by, "mean", "docs").agg((F.min("bin") / BINS).alias("limit"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, lang, text_hash, n_tokens, perplexity, limit (both log10, drawn towards the mean) and kept of every row."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    good = cut(trusted_ids(labels), "trusted")
    good = sized(good, good.count())
    wanted = cut(fitted_ids(rows.select("doc_id", "lang").join(good, "doc_id", "left_semi")), "fitted")
    wanted = sized(wanted, wanted.count())
    scores = cut(log_probabilities(rows, Model(trigram_counts(rows.join(wanted, "doc_id", "left_semi")))), "log10")
    known = scores.join(good, "doc_id", "left_semi").join(wanted, "doc_id", "left_anti")
    known = cut(known.select("lang", "log10", "n_tokens"), "trusted-scores")
    overall = _limit(known, []).first()
    mean_all, limit_all = (overall["mean"], overall["limit"]) if overall else (0.0, float("inf"))
    limits = _limit(known, ["lang"])
    drawn = [((F.col("docs") * F.col(c) + PRIOR_DOCUMENTS * every) / (F.col("docs") + PRIOR_DOCUMENTS)).alias(f"_{c}") for c, every in (("mean", mean_all), ("limit", limit_all))]
    limits = cut(limits.select(F.col("lang").alias("_lang"), *drawn), "limits")
    scored = scores.join(sized(limits, limits.count()), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    drawn_to, limit = F.coalesce("_mean", F.lit(mean_all)), F.coalesce("_limit", F.lit(limit_all)) + MARGIN
    return scored.select(
        F.col("doc_id").alias(key), "lang", "text_hash", "n_tokens", _shrunk(drawn_to).alias("perplexity"), limit.alias("limit"), (_shrunk(drawn_to) <= limit).alias("kept")
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without those that the classifier rejects."""
    gone = judge(docs, labels, key, text, lang).where("NOT kept").select(F.col(key).alias("_key"), F.col("lang").alias("_lang"), "text_hash").distinct()
    gone = cut(gone.withColumnRenamed("text_hash", "_hash"), "rejected")
    same = docs[key].eqNullSafe(F.col("_key")) & docs[lang].eqNullSafe(F.col("_lang")) & (F.xxhash64(docs[text]) == F.col("_hash"))
    return docs.join(sized(gone, gone.count()), same, "left_anti")
