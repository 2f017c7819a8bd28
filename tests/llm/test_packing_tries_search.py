"""Packing, the prefix trie and lexical search against brute force, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from fathomline.llm import lexical, packing, q_packing, tries

FILE = Path(public_tokenizers.path(q_packing.TOKENIZER)).read_text(encoding="utf-8")
WORDS = "The of and ship wind, gold river. stone light Ärger été! number 42 x_y it's H̱a".split()
DOCS = "doc_id bigint, text string, length int, offset string, n int"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c"), (6, "same"), (6, "same"), (None, "a null key"), (8, "x" * 9000), (9, "w ÀÉ, " * 20000), (10, "<|endoftext|> \x1c x \x85 y z 'sword İI ΑΣ. ﬁ")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 7, "clash", 1) for i, t in rows], DOCS)


def library_ids(text):
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(FILE)
    own.encode_special_tokens = True
    return own.encode(text or "", add_special_tokens=False).ids


def test_pieces_are_the_librarys(spark):
    rows = ODD + [(100 + k, prose(k, 300)) for k in range(20)]
    got = packing.tokenize(documents(spark, rows), FILE, capacity=64).collect()
    want = []
    for i, t in rows:
        ids = np.array([*library_ids(t), packing.END], "<u4")
        want += [(i, k // 64, k, len(ids[k : k + 64]), ids[k : k + 64].tobytes()) for k in range(0, len(ids), 64)]
    assert sorted(map(repr, ((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got))) == sorted(map(repr, want))


@pytest.mark.parametrize("chunk", [20_000, 40])
def test_packing_is_tight_and_whole(spark, monkeypatch, chunk):
    monkeypatch.setattr(packing, "BINS_A_CHUNK", chunk)  # 40: several partitions and rounds
    rng = random.Random(1)
    sizes = [rng.choice([1, 2, 5, 30, 61, 90, 100, 64]) for _ in range(400)] + [60] * 200
    pieces = spark.createDataFrame([(k % 7, k, s, f"own{k}") for k, s in enumerate(sizes)], "doc_id bigint, start bigint, length int, note string")
    got = packing.pack(pieces, capacity=100, nearly=4).collect()
    assert sorted(r["start"] for r in got) == list(range(len(sizes))) and all(r["note"] == f"own{r['start']}" for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    alone = sum(s > 50 for s in sizes)  # no two of these share a sequence
    assert len(by) <= max(-(-sum(sizes) // 100), alone) * (1.02 if chunk > 40 else 1.1) + 1


def test_only_pieces_over_half_end_after_a_round(spark, monkeypatch):
    monkeypatch.setattr(packing, "BINS_A_CHUNK", 10)
    pieces = spark.createDataFrame([(k, 70) for k in range(95)], "doc_id bigint, length int")
    assert packing.pack(pieces, capacity=100).select("sequence_id").distinct().count() == 95


def test_sequences_hold_the_ids(spark):
    packed = packing.pack(packing.tokenize(documents(spark, ODD[:7] + [(20, prose(1, 500))]), FILE, capacity=128), capacity=128)
    rows = sorted(packed.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    want = collections.defaultdict(bytes)
    for r in rows:
        want[r["sequence_id"]] += bytes(r["ids"])
    got = {r["sequence_id"]: (bytes(r["ids"]), r["n_tokens"]) for r in packing.sequences(packed).collect()}
    assert got == {k: (v, len(v) // 4) for k, v in want.items()}
    assert packing.pack(packing.tokenize(documents(spark, []), FILE)).count() == 0


def nodes_of(rows):
    """The trie of rebuilt conversations, counted plainly."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    ends = lambda p, cs: hashlib.sha256(",".join(map(str, sorted(c for c in cs if built[c] == p))).encode()).hexdigest()
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else -1, len(cs), kids[p], leaves[p], saved[p], ends(p, cs)) for p, cs in members.items())


TURNS = "conv_id bigint, turn bigint, role string, text string, digest string, words int, id int"


def trie_of(spark, rows, local):
    turns = spark.createDataFrame([(*r, "clash", 0, 0) for r in rows], TURNS)
    got = tries.trie(tries.rebuild(tries.encode_turns(turns)), local).collect()
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], *r[3:]) for r in got)


@pytest.mark.parametrize("local", [1, 12, 100_000])
def test_trie(spark, local):
    rng = random.Random(local)
    texts = ["hello there", "hi", "", None, "one two  three", "hi\nyou"]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in range(130) for t in range(rng.randrange(1, 6)) if c % 3 or c % 20 == 0]
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 320) for t in range(6)]  # a group of copies
    rows += [(400, None, "user", "null turn"), (400, 1, "user", "b"), (400, 1, "user", "a"), (400, 1, "user", "a"), (None, 1, "user", "no conversation")]
    rows += [(500, t, "user", str(t % 3)) for t in range(700)]  # one long conversation
    assert trie_of(spark, rows, local) == nodes_of(rows)


def test_trie_odd_tables(spark):
    assert trie_of(spark, [], 10) == []
    single = [(7, 1, "user", "base is absent")]  # its first turns come from conversation 0, which isn't there
    assert trie_of(spark, single, 10) == nodes_of(single)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, top):
    terms = lambda t: TERM.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    texts = [(k, collections.Counter(terms(t))) for k, t in docs]
    texts = [(k, c) for k, c in texts if c]
    n_docs, total = len(texts), sum(sum(c.values()) for _, c in texts)
    df = collections.Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, c in texts:
            m = 10 + (90 * sum(c.values()) * n_docs) // total
            s = sum(lexical.weights(n_docs, df[t]) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, key is None, key or 0))
        out += [(item, r + 1, None if null else key, -s) for r, (s, null, key) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [20_000, 64])
def test_search(spark, shard):
    docs = ODD + [(1000 + k, prose(k, 5 + k * 7 % 90)) for k in range(700)] + [(5000 + k, "gold River\x00stone_light") for k in range(30)]
    items = [(1, "Gold river STONE"), (2, "light-wind Ärger"), (3, None), (4, "no such terms qq"), (5, "x_y it's 42 H̱a"), (6, prose(3, 40)), (6, prose(3, 40)), (7, "null key"), (8, "w")]
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, rank int")
    frame = documents(spark, docs).repartition(1 if shard > 64 else 9)  # shards of one task, or of nine
    got = sorted((tuple(r) for r in lexical.search(frame, asked).collect()), key=repr)
    assert got == ranked(docs, items, 10)


def test_search_of_nothing(spark):
    asked = spark.createDataFrame([(1, "a", 0)], "item_id bigint, text string, rank int")
    assert lexical.search(documents(spark, []), asked).count() == 0
    assert lexical.search(documents(spark, ODD), asked.where("false")).count() == 0
    assert lexical.search(documents(spark, [(1, None)]), asked).count() == 0


def test_blocks_bound_and_skip():
    rng = np.random.default_rng(0)
    doc = np.sort(rng.choice(20_000, 3_000, replace=False)).astype(np.int64)
    score = rng.integers(1, 10**9, 3_000)
    low, high, peak = lexical.cut_blocks(doc, score)
    assert (low[1:] >= high[:-1]).all() and low[0] == doc[0] and high[-1] == doc[-1] + 1
    at = np.searchsorted(low, doc, side="right") - 1
    assert (doc < high[at]).all() and (score <= peak[at]).all()
    error = lambda b: float((b[2] * (b[1] - b[0])).sum()) + lexical.BLOCK_COST * score.mean() * len(b[0])
    fixed = [(doc[k], doc[min(k + 64, 3_000) - 1] + 1, score[k : k + 64].max()) for k in range(0, 3_000, 64)]
    assert error((low, high, peak)) < error(tuple(map(np.array, zip(*fixed, strict=True))))
    # Terms that live in their own documents: what can't reach the threshold isn't read.
    term = np.r_[np.zeros(500, np.int64), np.ones(500, np.int64)]
    shard = lexical.Shard(100_000, term, np.r_[np.arange(500), 50_000 + np.arange(500) * 90], np.r_[np.full(500, 900), np.full(500, 100)])
    docs, scores, reads = shard.search([0, 1], 10)
    edges, _ = shard.bounds([0, 1])
    assert scores.min() == 900 and len(docs) == 500 and reads < len(edges) - 1
