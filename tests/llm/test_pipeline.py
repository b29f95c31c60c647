"""The pipeline's stages on small tables, and the queries as they are registered."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from barwright.llm import decontamination

DIR = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if re.match(r"op\d", x)} and "pipeline" in names


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, DIR)
        assert kept.columns == docs.columns, name
        assert kept.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0, name
        assert kept.count() > 0.75 * before.count(), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, DIR)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").collect()}


def test_contaminated_documents_go(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    item = bench.first()["text"]
    planted = docs.limit(1).withColumns({"doc_id": F.lit(10**6), "text": F.lit(item)})
    out = corpus_pipeline.drop_contaminated(spark, docs.unionByName(planted), DIR)
    assert out.where("doc_id = 1000000").count() == 0
    bad = decontamination.digest(docs, bench).where("contaminated").count()
    assert out.count() == docs.count() - bad


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert out.count() > 0 and "sequence_id" in out.columns


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_nothing(spark, stage):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    assert stage(spark, docs, DIR).count() == 0
