"""The pipeline's stages keep columns and take effect."""

import corpus_pipeline
from filmspark.llm import viterbi

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, docs
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == columns
            now = now.cache()
            seen[name] = now.count()
    assert seen["toxicity"] > seen["simhash near-dedup"] > 0
    assert seen["suffix-array dedup"] == seen["simhash near-dedup"]
    rows = now.collect()
    p = viterbi.pieces(viterbi.MODEL)
    import numpy as np

    assert all(r.n_tokens == len(r.token_ids) for r in rows)
    assert {p.decode(np.array(r.token_ids, int)).decode() for r in rows if r.token_ids}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_null_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "kept text", "en", "s", 9), (3, None, None, None, None)], docs.schema)
    now = odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        now = stage(spark, now, SF)
    assert sorted((r.doc_id or 0, r.text or "") for r in now.collect()) == [(0, ""), (0, "kept text"), (3, "")]
    mixed = corpus_pipeline.mix_sources(spark, odd, SF)
    assert mixed.columns == docs.columns
    out = corpus_pipeline.tokenise(spark, odd.union(odd), SF).collect()
    assert sorted((r.doc_id or 0, r.n_tokens == 0) for r in out) == [(0, False), (0, False), (0, True), (0, True), (3, True), (3, True)]


def test_repeated_ids_lose_copies_only(spark):
    """An id that comes with several texts loses those that are copies of a smaller id's, and no other."""
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a), (2, a), (2, b), (3, "x y z"), (3, "x y z"), (1, "quite another text of some words")]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert got == sorted([(1, a), (2, b), (3, "x y z"), (1, "quite another text of some words")])


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", "x"), (2, "one two three four five six", "y")], "doc_id long, text string, __row string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == ["doc_id", "text", "__row"] and [tuple(r) for r in got.collect()] == [(1, "one two three four five six", "x")]
