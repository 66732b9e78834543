import os

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries

from .cases import no_documents, odd_documents

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_queries_are_registered():
    names = queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(oracle_sql()) <= set(names)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_stages_on_odd_rows_and_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_documents(spark), no_documents(spark)):
            out = stage(spark, docs, SMALL)
            out.collect()
            if name != "byte-level bpe":
                assert out.columns == docs.columns


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] > counts[4] == counts[5]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect()))
