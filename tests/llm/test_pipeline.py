"""The stages of the corpus pipeline, one after the other, on the smallest tables."""

import corpus_pipeline
from pyspark.sql import functions as F

from momentlake.llm.quality_rules import judge


def test_stages_take_effect(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for k, (_name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert after.exceptAll(docs).isEmpty()
        assert 0 < after.count() <= docs.count()
        docs = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    sums = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("want"))
    assert sums.where("n <> want").isEmpty()
    assert {r[0] for r in sums.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_a_filter_stays_above_the_verdict(spark):
    """Pushed below, it would repeat each lambda in the next one; such a plan was never done compiling."""
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "a b"), (3, None)], "doc_id long, text string")
    kept = judge(docs, [0.1] * (1 << 14)).where("kept").select("doc_id", "text")
    assert [r["doc_id"] for r in kept.collect()] == [1]
