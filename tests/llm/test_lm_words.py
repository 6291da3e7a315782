"""Inside its class a word has a chance of its own in every context, and the chances of all words sum to one."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.llm import maxent
from faultline.llm.common import documents, remainder


def test_words_of_one_class_are_told_apart_by_their_contexts(spark):
    """Words of equal frequency, each always behind a word of its own: another word of its class scores less there."""
    columns = "doc_id long, text string"
    ids = spark.createDataFrame([(i, "") for i in range(9000)], columns)
    kept_out = [r.doc_id for r in ids.filter(remainder(10) == 0).collect()]
    rows = [(i, f"a{i % 40} w{i % 40}") for i in sorted(set(range(9000)) - set(kept_out))]
    training = spark.createDataFrame(rows, columns)
    known, _, _ = maxent.vocabulary(maxent.word_counts(training).cache(), len(rows))
    at, found = known.find(maxent.token_stream(pa.array([f"w{k}" for k in range(40)]))[0][::2])
    assert found.all()
    pairs = [(k, j) for k in range(40) for j in range(40) if k != j and known.classes[at[k]] == known.classes[at[j]]]
    assert len(pairs) > 20
    tried = [pair for k, j in pairs for pair in ((k, k), (k, j))]
    rows += [(i, f"a{k} w{j}") for i, (k, j) in zip(kept_out, tried)]
    got = {r.doc_id: r for r in maxent.score_report(spark.createDataFrame(rows, columns)).filter("held_out").collect()}
    scores = [got[i].score for i, _ in zip(kept_out, tried)]
    assert len(scores) == len(tried)
    assert min(own - other for own, other in zip(scores[::2], scores[1::2])) > 0.1


@pytest.mark.parametrize("top", [400_000, 300])
def test_chances_of_words_sum_to_one_in_any_context(spark, monkeypatch, top):
    monkeypatch.setattr(maxent, "TOP", top)
    docs = documents(spark, "/root/testdata/sf0.001").select("doc_id", "text")
    training = docs.filter(remainder(10) != 0)
    known, tokens, rest = maxent.vocabulary(maxent.word_counts(training).cache(), training.count())
    weights = maxent.train(training, spark.sparkContext.broadcast(known), tokens)
    outer, inner = maxent.tables(weights)
    assert np.abs(inner).max() > 0.1
    text = docs.filter(F.length("text") > 200).first().text
    stream, bounds = maxent.token_stream(pa.array([text]))
    contexts, words = maxent.contexts_of(stream, bounds), np.arange(len(known.words))
    for place in (0, 1, 7, 20):
        same = np.repeat(contexts[maxent.INNER_CONTEXTS, place : place + 1], len(words), axis=1)
        chance = np.exp(maxent.word_chances(known, inner, words, words, same))
        inside = np.bincount(known.classes, weights=chance, minlength=maxent.CLASSES)[1:-1]
        assert np.allclose(inside[np.bincount(known.classes, minlength=maxent.CLASSES)[1:-1] > 0], 1, atol=1e-4)
        plain = np.exp(maxent.word_chances(known, np.zeros_like(inner), words, words, same))
        assert np.allclose(plain, 10.0**known.share, rtol=1e-4)
        assert np.abs(np.log(chance / plain)).max() > 0.1


def test_paths_are_those_of_the_trees():
    """Against a walk from the root, one word at a time."""
    rng = np.random.default_rng(1)
    n = np.sort(np.r_[rng.integers(1, 50, 700), 2.0 ** np.arange(12)])[::-1].astype(np.float64)
    classes = 1 + np.minimum(13, (np.cumsum(n) - n / 2) * 14 / n.sum()).astype(np.int64)
    order = rng.permutation(len(n))
    root, child, odds = maxent.trees(n, classes)
    depth, start, path, table = maxent.paths(n, classes, order)
    for k, rank in enumerate(order):
        node, level = root[classes[rank]], 0
        while node:
            step = path[start[k] + level // maxent.LEVELS]
            digits, inside = step % maxent.INNER, level % maxent.LEVELS
            slot = (1 << inside) | (digits >> (maxent.LEVELS - inside))
            assert table[step // maxent.INNER, slot] == odds[node]
            right = rank >= node
            assert right == (digits >> (maxent.LEVELS - 1 - inside)) & 1
            node, level = child[2 * node + right], level + 1
        assert level == depth[k]
    assert maxent.paths(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))[3].shape == (0, maxent.INNER)


@pytest.mark.parametrize("size", [0, 1, 2, 3000])
def test_words_are_found_by_their_upper_bits(size):
    rng = np.random.default_rng(size)
    words = np.unique(np.r_[rng.integers(0, 2**64, size, dtype=np.uint64), np.array([0, 2**64 - 1, 5, 6, 7][:size], np.uint64)])
    asked = np.r_[words, words + np.uint64(1), rng.integers(0, 2**64, 500, dtype=np.uint64)]
    fields = {name: None for name in maxent.Vocabulary.__dataclass_fields__}
    found = maxent.Vocabulary(**{**fields, "words": words, "firsts": maxent.first_places(words)})
    at, known = found.find(asked)
    assert (known == np.isin(asked, words)).all() and (not size or (words[at[known]] == asked[known]).all())


def test_sums_of_tasks_keep_eight_digits():
    values = np.r_[0.0, 1.0, -3.5, 1e-6, 123456.0, -7.7e9]
    assert np.allclose(maxent.doubled(maxent.halved(values)), values, rtol=2**-8)
