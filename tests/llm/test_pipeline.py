"""The pipeline's removals against brute force, where ids repeat, and on odd rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathomline.llm import decontaminate, secrets

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int"
WORDS = "the of and ship wind gold river stone light number".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(n))


def changed(text, at, word):
    w = text.split()
    w[at] = word
    return " ".join(w)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def kept_by_hand(rows):
    """Near-duplicate groups by comparing all pairs."""
    shingles = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        shingles.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(shingles[a] & shingles[b])
            if both and 100 * both >= 80 * (len(shingles[a]) + len(shingles[b]) - both):
                label[top(a)] = top(b)
    groups = {}
    for k, s in enumerate(shingles):
        if s:
            groups.setdefault(top(k), []).append(k)
    kept = [k for k, s in enumerate(shingles) if not s]
    for members in groups.values():
        least = min((rows[k][0] is not None, rows[k][0] or 0) for k in members)
        kept.append([k for k in members if (rows[k][0] is not None, rows[k][0] or 0) == least][0])
    return kept


def test_near_duplicates_by_id_and_text(spark):
    w, other = prose(1, 80), prose(2, 90)
    rows = [(1, w, "s"), (1, w, "s"), (2, other, "s"), (2, changed(w, 40, "x"), "s"), (3, None, "a"), (3, None, "a"), (4, "", "a"), (None, prose(3, 60), "a")]
    rows += [(100 + k, prose(50 + k, 70), "s") for k in range(60)] + [(300 + k, changed(prose(50 + k % 60, 70), k % 70, "y"), "s") for k in range(120)]
    rows += [(600, prose(9, 20_000), "long"), (601, changed(prose(9, 20_000), 777, "z"), "long"), (602, changed(prose(9, 20_000), 5, "q"), "long")]
    docs = table(spark, rows)
    got = corpus_pipeline.near_dups(spark, docs, "")
    assert got.columns == docs.columns
    want = sorted((repr(rows[k][:2]) for k in kept_by_hand(rows)))
    assert sorted(repr((r["doc_id"], r["text"])) for r in got.collect()) == want


def test_contaminated_by_id_and_text(spark):
    item = prose(7, 40)
    rows = [(1, prose(1, 50) + " " + item, "s"), (1, prose(2, 50), "s"), (2, None, "s"), (None, item, "s"), (None, "else", "s")]
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = decontaminate.drop_contaminated(table(spark, rows), items)
    assert got.columns == SCHEMA.replace(",", "").split()[::2]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(repr, [(1, prose(2, 50)), (2, None), (None, "else")]))


def test_secrets_and_tokens_keep_rows(spark):
    rows = [(1, 'password = "hunter2hunter2"', "s"), (1, None, "s"), (2, "", "s"), (None, "plain text", "s")]
    out = corpus_pipeline.secrets(spark, table(spark, rows), "")
    marked = [r for r in out.collect() if "[SECRET]" in (r["text"] or "")]
    assert len(marked) == 1 and "hunter2" not in marked[0]["text"] and marked[0]["n_chars"] == len(marked[0]["text"])
    rest = [repr((r["doc_id"], r["text"], r["n_chars"])) for r in out.collect() if "[SECRET]" not in (r["text"] or "")]
    assert sorted(rest) == sorted(map(repr, [(1, None, None), (2, "", 0), (None, "plain text", 10)]))
    assert corpus_pipeline.tokens(spark, out, "").count() == 4


def test_a_column_named_like_the_result_is_an_error(spark):
    docs = table(spark, [(1, "a", "s")]).withColumn("secrets", F.lit(1))
    with pytest.raises(ValueError, match="secrets"):
        secrets.find_secrets(docs)
    assert set(secrets.find_secrets(docs, out="found").columns) == {*docs.columns, "found"}
