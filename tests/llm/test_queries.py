"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import compare
import corpus_pipeline
import pytest

from repopulse.llm import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    found = compare.spark_rows(QUERIES[name](spark, SF_DIR))
    assert compare.differences(found, compare.sql_rows(compare.connect(SF_DIR), ORACLE_SQL[name])) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_work_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.store(stage(spark, docs, SF_DIR), name)
        seen.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").isEmpty()
        if name == "simhash":
            assert corpus_pipeline.near_duplicates(docs).where("doc_id <> component_id").isEmpty()
    assert docs.selectExpr("count(distinct doc_id)").first()[0] <= seen[3]
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3)], before.schema)
    for name, stage in corpus_pipeline.STAGES:
        odd = corpus_pipeline.store(stage(spark, odd, SF_DIR), name)
    assert odd.count() >= 1
    nothing = spark.createDataFrame([], before.schema)
    for name, stage in corpus_pipeline.STAGES:
        nothing = corpus_pipeline.store(stage(spark, nothing, SF_DIR), name)
    assert nothing.count() == 0
