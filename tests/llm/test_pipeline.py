"""The stages of the corpus pipeline on a small corpus with planted cases."""

import numpy as np

import corpus_pipeline
from credence.llm import decontam
from tests.llm.test_operators import DOC, near_copies

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_rows_that_are_clean(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert 0.5 * docs.count() < out.count() <= docs.count(), name
    pieces = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset"} <= set(pieces.columns) and pieces.count() > 0


def test_near_copies_leave_one(spark):
    docs = spark.createDataFrame(near_copies(1), DOC)
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, SF)
    assert kept.count() < docs.count() and kept.columns == docs.columns


def test_what_the_latent_search_finds_is_dropped(spark, monkeypatch):
    """Documents that hold an item in another order go by the latent search, and stay where it finds nothing."""
    items = [r["text"].split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = spark.createDataFrame([(9000 + k, " ".join(["quite", "other", "words", *w[::-1], "at", "both", "ends"]), None, None, 0) for k, w in enumerate(items)], DOC)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_leaks(spark, docs.unionByName(planted), SF).collect()}
    monkeypatch.setattr(decontam, "_latent", lambda spark, columns, own, idf, passages: np.zeros((len(idf), 1)))
    without = {r["doc_id"] for r in corpus_pipeline.drop_leaks(spark, docs.unionByName(planted), SF).collect()}
    assert len(kept & set(range(9000, 9000 + len(items)))) <= 0.1 * len(items) and without >= set(range(9000, 9000 + len(items)))
    assert {d for d in kept if d < 9000} == {d for d in without if d < 9000}
