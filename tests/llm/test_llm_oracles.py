"""Registered training-data queries against their SQL, and against plain definitions where SQL has no form."""

import brute
import pytest

from perfweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(duck_small):
    return duck_small.execute("SELECT doc_id, text FROM documents").fetchall()


@pytest.fixture(scope="module")
def duck_small():
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, duck_small, key):
    got = queries.REGISTRY[key](spark, SF)
    res = duck_small.execute(queries.ORACLE_SQL[key])
    cols = sorted(d[0] for d in res.description)
    assert sorted(got.columns) == cols
    at = {d[0]: i for i, d in enumerate(res.description)}
    want = sorted((tuple(r[at[c]] for c in cols) for r in res.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == want


def test_quality_query(spark, rows):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in queries.REGISTRY["op6_quality_risk"](spark, SF).collect()}
    assert got == {i: brute.quality(t) for i, t in rows}


def test_packing_query(spark, rows):
    got = queries.REGISTRY["op10_packing_bestfit"](spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute.pieces(rows)


def test_pipeline(spark):
    """Every stage keeps the columns of documents; the last row count equals the pieces of what the stages kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns, name
        after = after.cache()
        assert 0 < after.count() <= kept.count(), name
        kept = after
    assert not kept.where("text RLIKE '[0-9a-f]{16,}'").count()
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    sets = {i: brute.shingles(t) for i, t in texts}
    assert all(v == k for k, (_, v) in brute.jaccard([(i, t) for i, t in texts if "[SECRET]" not in t]).items()) and sets
    got = queries.REGISTRY["pipeline"](spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute.pieces(texts)
