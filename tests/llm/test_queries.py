"""The registered queries against their SQL, and the pipeline."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from checks.compare import database, difference
from perilscope.llm.queries import ORACLES, QUERIES, SHARDS

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not there")


def test_all_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert entry_point.queries().keys() >= QUERIES.keys() | {"pipeline"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    found = QUERIES[name](spark, FOLDER).toArrow()
    assert difference(found, database(FOLDER).sql(ORACLES[name]).to_arrow_table()) is None


def test_whitening_has_a_row_for_each_vector_and_component(spark):
    found = QUERIES["op13_whitening"](spark, FOLDER).collect()
    ids = [r["vec_id"] for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    assert sorted((r["vec_id"], r["component"]) for r in found) == [(i, c) for i in sorted(ids) for c in range(1, 5)]
    assert max(r["identity_error"] for r in found) <= 1e-9


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys() - {"op13_whitening"}))
def test_rows(spark, name):
    found = QUERIES[name](spark, FOLDER)
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert found.count() == documents and "doc_id" in found.columns


def test_language_is_right_on_held_out_documents(spark):
    rows = QUERIES["op4_language"](spark, "/root/testdata/sf0.01").collect()
    langs = dict(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()
    )
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.99 * len(held)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept, rows = {r["doc_id"] for r in docs.collect()}, None
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, FOLDER)
        if name != "sharding":
            assert after.columns == docs.columns
        rows = after.collect()
        ids = {r["doc_id"] for r in rows}
        assert ids <= kept
        if name == "language":
            assert len(ids) >= 0.99 * len(kept)
        if name == "decontamination":
            assert len(ids) >= 0.9 * len(kept)
        if name == "sharding":
            assert len(rows) == docs.count() and {r["shard_name"] for r in rows} <= set(SHARDS)
        docs, kept = spark.createDataFrame(rows, after.schema).repartition(3), ids
    run = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, run.collect())) == sorted(map(str, rows))


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "benchmark"):
        table = spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0)
        table.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
