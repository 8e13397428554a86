"""The ten queries and the pipeline over the small tables."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from tagmill.llm import langid
from tagmill.llm.queries import ORACLES, QUERIES


def test_one_query_an_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, data, same):
    assert same(QUERIES[name](spark, data), ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_a_document(name, spark, data):
    got = QUERIES[name](spark, data)
    assert got.select("doc_id").distinct().count() == got.count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", None, "s", 0), (10**6 + 2, "the of and " * 50_000, "en", "s", 1)], docs.schema)
    frame = docs.unionByName(odd)
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = frame
        frame = stage(spark, before, data)
        assert frame.columns == docs.columns and frame.dtypes == docs.dtypes
        ids = {r.doc_id for r in frame.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        seen.append((name, len(ids)))
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        frame.write.mode("overwrite").parquet(path)
        frame = spark.read.parquet(path)
    kept = {r.doc_id: r.text for r in frame.collect()}
    assert 10**6 not in kept and 10**6 + 1 not in kept and 10**6 + 2 in kept
    assert len(kept) > 0.7 * docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, frame, data)
    assert last.count() == len(kept)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.text, []).append(r.doc_id)
    for ids in texts.values():  # of exact copies one stays at most
        assert sum(i in kept for i in ids) <= 1
    counts = [n for _, n in seen]
    assert counts == sorted(counts, reverse=True)


def test_pipeline_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_pipeline_over_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0


def test_language_stage_keeps_all_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    wide = docs.withColumnRenamed("source", "lang_pred")
    kept = langid.accepted(wide, langid.train(langid.sample(wide)))
    assert kept.columns == wide.columns and kept.count() <= wide.count()
