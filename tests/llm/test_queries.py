"""The registered queries over the smallest tables: contracts, SQL where there is any, and the pipeline."""

import duckdb
import pytest

from fathomline.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id", "item_id"},
    "op2": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op3": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op4": {"doc_id", "kept"},
    "op5": {"page_id", "url", "text", "n_chars"},
    "op6": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op7": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op8": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op9": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op10": {"doc_id", "n_shingles", "component_id", "kept"},
    "op11": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op12": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
    "op13": {"item_id", "rank", "doc_id", "score"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, name):
    df = QUERIES[name](spark, SF)
    assert COLUMNS[name.split("_")[0]] <= set(df.columns)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    key = {"op5": "pages", "op9": "conversations"}.get(name.split("_")[0], "documents")
    if name.startswith("op9"):
        assert df.count() == con.execute("SELECT count(DISTINCT conv_id) + 1 FROM conversations").fetchone()[0]
    elif name.startswith("op11"):
        assert df.select("doc_id").distinct().count() == con.execute("SELECT count(DISTINCT doc_id) FROM documents").fetchone()[0]
    elif not name.startswith(("op1_", "op12", "op13")):
        assert df.count() == con.execute(f"SELECT count(*) FROM {key}").fetchone()[0]
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, left = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, SF)
        assert out.columns == names, name
        assert out.count() <= left.count()
        left = out
    final = corpus_pipeline.run(spark, SF)
    assert final.count() == left.count() and final.count() > 0
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
