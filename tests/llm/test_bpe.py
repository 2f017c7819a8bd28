"""Merges of words, and what a worker keeps between operators."""

import random

import public_tokenizers as p
import pytest

from fathomline.llm import bpe, common


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(p.path("byte_bpe_multi_50k.tiktoken")), p.PATTERN)


def by_hand(ranks, word):
    parts = [word[k : k + 1] for k in range(len(word))]
    while found := [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
        _, k = min(found)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[x] for x in parts]


def test_words_are_merged_by_rank(codec):
    rng = random.Random(3)
    letters = "etaoin shrdluä中\U0001f600-_0"
    words = ["".join(rng.choice(letters[: rng.randrange(2, len(letters))]) for _ in range(rng.randrange(1, 60))) for _ in range(1500)] + ["a" * 255, "ab" * 100]
    for w in words:
        raw = w.encode()
        want = [codec.ranks[raw]] if raw in codec.ranks else by_hand(codec.ranks, raw)
        assert codec.merge(raw) == want
        if raw not in codec.ranks:
            assert codec.heap_merge(raw) == want


def test_texts_come_back(codec):
    texts = ["", "ship " * 9, "x" * 3000, "gold\x00中\n\n wind"]
    ids, decoded = codec.run(texts)
    assert decoded == [t.encode() for t in texts] and all(len(i) % 4 == 0 for i in ids)


def test_workers_keep_one_operator(codec):
    """The codec stayed in a worker beside what other operators keep: stages of the pipeline added up."""
    other = common.worker_cache()
    other["memo"] = bpe._codecs["codec"] = codec
    common.release(bpe._codecs)
    assert not other and bpe._codecs
    common.release(other)
    assert not bpe._codecs
