"""Registered corpus queries against their SQL, and the pipeline stage by stage."""

from pathlib import Path

import corpus_pipeline
import oracle
import pytest

import __spark_entry__ as entry
from zygospark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem, rows, _ = oracle.check(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert problem is None
    assert rows > 0


def test_registered():
    assert {"pipeline", *QUERIES} <= set(entry.queries())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, SF))
        assert docs.columns[: len(columns)] == columns and docs.count() > 0
        if name != "mix_sources":
            assert docs.columns == columns
            assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))
