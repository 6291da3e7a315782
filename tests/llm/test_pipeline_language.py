"""The mark of the first pipeline stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import language

DIRECTORY = "/root/testdata/sf0.001"


def test_mark_follows_the_number_of_languages():
    assert corpus_pipeline.clear_score(4) == pytest.approx(0.35)
    assert corpus_pipeline.clear_score(1) == 0
    for n in (2, 3, 20, 300):
        assert 1 / n < corpus_pipeline.clear_score(n) < 2 / n


def test_texts_without_labels_stay(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    assert language.learn(docs) is None
    kept = corpus_pipeline.identify_language(spark, docs, DIRECTORY)
    assert kept.count() == docs.filter(F.col("text").rlike(r"\p{L}")).count() > 0
