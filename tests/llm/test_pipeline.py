import pytest
from oracle import connect, rows_of, rows_of_sql

import corpus_pipeline
from tidewire.llm import queries
from tidewire.llm.common import written

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == rows_of_sql(connect(SF), queries.SQL[name])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, SF), "test-stage")
        if k < 4:
            assert out.columns == columns and 0 < out.count() <= docs.count()
            assert out.join(docs, "doc_id", "left_anti").count() == 0
            docs = out
    assert out.select("doc_id").distinct().count() == docs.count()


def test_stages_stand_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() >= 0


def test_all_operators_are_registered():
    import __spark_entry__ as entry

    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in entry.queries() if q.startswith("op")}
    assert "pipeline" in entry.queries()
