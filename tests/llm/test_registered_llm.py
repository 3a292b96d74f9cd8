"""The registered queries against SQL, the pipeline's stages, and the borders of this subpackage."""

from pathlib import Path

import pytest

import corpus_pipeline
from __spark_entry__ import queries
from chatlens.llm.queries import llm_oracles, llm_queries
from tools.compare import compare, connect

SMALL = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parent.parent.parent


def test_every_operator_and_the_pipeline_are_registered():
    names = list(llm_queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(names) < set(queries()) and "pipeline" in queries()


@pytest.mark.parametrize("name", list(llm_oracles()))
def test_same_rows_as_sql(spark, name):
    problem, rows = compare(spark, connect(SMALL), SMALL, name, llm_queries()[name], llm_oracles()[name])
    assert problem == "" and rows


def test_nothing_else_imports_this_subpackage():
    others = [f for d in ("chatlens", "checks", "tools") for f in (REPO / d).rglob("*.py") if "llm" not in f.parts]
    assert not [f for f in [*others, REPO / "bench.py"] if "chatlens.llm" in f.read_text()]


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), name, scratch=False)
        assert docs.columns == columns, name
        assert docs.count() <= before and docs.count(), name
        before = docs.count()
    last = corpus_pipeline.tokens_stage(spark, docs, SMALL)
    assert last.count() == before


def test_stages_take_odd_and_no_documents(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SMALL).count() <= docs.count()
