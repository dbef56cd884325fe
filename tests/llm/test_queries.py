"""Registered queries next to SQL, and the pipeline's stages."""

import check
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_quality_rules", "op7_benchmark_decontamination"])
def test_query_equals_sql(spark, name):
    ok, note = check.compare(entry.queries()[name](spark, SF), check.connect(SF), entry.oracle_sql()[name])
    assert ok, note


def test_all_queries_are_there():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(20)).unionByName(docs.limit(2).withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes}))
    docs = docs.withColumns({"kept": F.lit(7), "spans": F.lit("x"), "n_words": F.lit(1)})
    held, last = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, SF).cache()
        assert held.columns == docs.columns, name
        assert 0 < held.count() <= last
        last = held.count()
    assert held.where("text LIKE '%token = \"%'").count() == 0 and held.where("kept <> 7 OR n_chars <> length(text)").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, held, SF)
    assert pieces.select("doc_id").distinct().count() == held.select("doc_id").distinct().count()
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
