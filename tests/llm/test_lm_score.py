"""The score is the logarithm of a probability, and context helps on texts held out."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.llm import maxent
from faultline.llm.common import documents, remainder


@pytest.mark.parametrize("top", [400_000, 1_500])
def test_chances_of_all_words_sum_to_one(spark, monkeypatch, top):
    monkeypatch.setattr(maxent, "TOP", top)
    docs = documents(spark, "/root/testdata/sf0.001").select("doc_id", "text")
    training = docs.filter(remainder(10) != 0)
    counts = maxent.word_counts(training).cache()
    known, tokens, rest = maxent.vocabulary(counts, training.count())
    sent = spark.sparkContext.broadcast(known)
    weights = maxent.train(training, sent, tokens)
    texts = pa.array(docs.limit(20).toPandas()["text"].fillna("").tolist(), pa.string())
    stream, bounds = maxent.token_stream(texts)
    chances = np.exp(maxent.class_chances(weights, known.prior, maxent.features(stream, bounds, len(weights))))
    assert np.allclose(chances.sum(1), 1, atol=1e-4)
    inside = np.bincount(known.classes, weights=10.0**known.share, minlength=maxent.CLASSES)
    more = 0.0
    if rest is not None:
        gain = F.log10(F.col("n") + maxent.SMOOTH) - F.log10(F.lit(maxent.SMOOTH))
        more = rest.select(F.sum(F.pow(F.lit(10.0), gain + known.unknown_share))).first()[0]
    inside[0] = 1.0  # the end is alone in its class
    inside[-1] = more + 10.0**known.unknown_share
    assert (rest is None) == (top == 400_000) and np.allclose(inside[[0, -1]], 1, atol=1e-6)
    assert np.allclose(inside[1:-1], 1, atol=1e-6)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_held_out_texts_score_above_their_base(spark, sf):
    rows = maxent.score_report(documents(spark, f"/root/testdata/sf{sf}")).filter("held_out")
    sums = rows.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (sums[0] - sums[1]) / sums[2] > 0.05


def test_buckets_grow_with_the_tokens():
    sizes = [maxent.buckets_for(n) for n in (0, 10**5, 10**6, 10**7, 10**12)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[2] < sizes[3] and all(n % maxent.BLOCKS == 0 for n in sizes)


def test_words_outside_the_vocabulary_join_by_row(spark, monkeypatch):
    """Equal texts, null ids and repeated rows each keep their own score."""
    rows = [(1, "a b c a"), (1, "a b c a"), (None, "a b c a"), (2, None), (3, "z z y")] + [(i, "a b q" + str(i)) for i in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r[:6]) for r in maxent.score_report(docs.fillna(0)).collect())
    monkeypatch.setattr(maxent, "TOP", 2)
    few = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r[:6]) for r in maxent.score_report(docs.fillna(0)).collect())
    assert len(few) == len(rows) and few == whole
