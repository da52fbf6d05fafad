"""The registered corpus queries as the driver calls them: columns, DuckDB twins, odd tables with clashing names."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from credence.llm import queries
from tests.llm.test_operators import DOC, ODD, SF
from tests.test_catalog import plain

#: The columns that each query begins with, as agreed.
COLUMNS = {
    "op1_pii_spans": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op2_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op3_co_training": ["doc_id", "score"],
    "op4_latent_decontamination": ["doc_id", "item_id"],
    "op5_block_matrix_ann": ["query_id", "rank", "vec_id", "score"],
    "op6_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op7_pack_sequences": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op8_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_minimax_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op10_id_store": ["doc_id", "start", "n_tokens", "ids_crc32"],
}
CLASHES = ("rid", "size", "part", "row", "digest", "score", "line", "seq", "n", "keep", "spans", "good", "label", "block", "v", "__text", "columns")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders of odd tables, with clashing names, and of empty ones."""
    odd, none = (str(tmp_path_factory.mktemp(x)) for x in ("odd", "none"))
    docs = spark.createDataFrame(ODD, DOC).unionByName(spark.read.parquet(f"{SF}/documents.parquet"))
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("clash"))
    docs.write.parquet(f"{odd}/documents.parquet")
    docs.limit(0).write.parquet(f"{none}/documents.parquet")
    for t in ("embeddings", "benchmark", "labels"):
        found = spark.read.parquet(f"{SF}/{t}.parquet").withColumn("rid", F.lit("clash")).withColumn("good", F.lit(1)).withColumn("block", F.lit("x"))
        found.write.parquet(f"{odd}/{t}.parquet")
        found.limit(0).write.parquet(f"{none}/{t}.parquet")
    return odd, none


def test_every_query_has_its_columns_listed():
    assert list(COLUMNS) == list(queries.QUERIES)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query_on_odd_and_empty_tables(spark, tables, name):
    odd, none = tables
    found = queries.QUERIES[name](spark, odd)
    assert found.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = found.collect()
    if name.split("_")[0] in ("op1", "op2", "op3", "op6", "op8", "op9", "op10"):
        assert len(rows) == spark.read.parquet(f"{odd}/documents.parquet").count()
    if name == "op8_language_id":
        held = {r["doc_id"]: r["held"] for r in spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held")).collect()}
        assert all(r["held_out"] == held[r["doc_id"]] for r in rows)
    if name == "op9_minimax_shards":
        assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None} and {r["shard"] for r in rows} == set(range(8))
    assert queries.QUERIES[name](spark, none).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    mine = queries.QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    theirs = duck.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert plain(mine.select(*columns).collect()) == plain(theirs)
