"""The queries over the smallest tables, against SQL or brute force, and the pipeline."""

import pytest

from helixframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf_dir, same, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"op11_multi_index"}))
def test_a_row_for_each_document(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir).select("doc_id").collect()
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in ids)


def test_held_out_accuracy(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in queries.QUERIES["op6_language_id"](spark, sf_dir).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    counts = [docs.count()]
    for name, stage in pipeline.STAGES:
        kept = stage(spark, kept, sf_dir)
        rows = kept.collect()
        counts.append(len(rows))
        if name != "encode":
            assert kept.columns == columns
            kept = spark.createDataFrame(rows, docs.schema)
    assert counts[1] > 0.95 * counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[5] == counts[4]
    empty = docs.where("doc_id < 0")
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name
