"""The registered training-data queries against DuckDB, and the pipeline."""

import importlib.util

import pytest

from tesserae.llm import queries

from ..oracle import SF, compare, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLES:
        compare(df, con, queries.ORACLES[name])
    else:
        table = "pages" if name.startswith("op6") else "documents"
        assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "encoding"]
    docs = start = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == start.columns and out.count() <= docs.count()
        docs = out
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() == docs.count() > 0 and {"doc_id", "n_tokens", "ids"} == set(rows.columns)
    empty = start.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
