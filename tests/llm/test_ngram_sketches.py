"""Sketches of the n-gram join: no link is lost to them, and pairs that are no link rarely pass."""

import numpy as np
import pyarrow as pa

from faultline.llm import ngramjoin
from faultline.llm.shingles import folded, sketch


def sets_apart(rng, n, changed):
    a = np.unique(rng.integers(0, 1 << 58, n, dtype=np.uint64))
    b = np.unique(np.r_[a[changed:], rng.integers(0, 1 << 58, changed // 2, dtype=np.uint64)])
    return a, b


def test_sketches_differ_in_no_more_bits_than_the_sets_in_members():
    rng = np.random.default_rng(1)
    for n in (1, 3, 64, 65, 130, 600, 2049, 5000):
        for changed in {0, 1, n // 9, n // 5, n // 2}:
            a, b = sets_apart(rng, n, changed)
            if not len(b):
                continue
            pair = [(int.from_bytes(sketch(x)), 8 * len(sketch(x))) for x in (a, b)]
            words = [ngramjoin.words_of(sketch(x)) for x in (a, b)]
            width = min(len(w) for w in words)
            apart = ngramjoin.bits_apart(*pair)
            assert apart == np.bitwise_count(folded(words[0], width) ^ folded(words[1], width)).sum()
            assert apart <= len(np.setxor1d(a, b))


def screened(rows):
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * 4, pa.int32(), pa.binary()])]
    names = [*ngramjoin.columns_of(ngramjoin.SCREENED), "sketch"]
    found = ngramjoin.screen_groups(iter([pa.RecordBatch.from_arrays(columns, names)]))
    return [tuple(r.values())[2:4] for batch in found for r in batch.to_pylist()]


def test_sets_without_a_linkable_partner_stay_out_of_the_trees():
    rng = np.random.default_rng(2)
    near = sets_apart(rng, 900, 60)  # Jaccard 0.9: linked
    far = [sets_apart(rng, 900, 300)[k] for k in (0, 1)]  # 0.57: the sizes and lists alone allow a link
    rows = []
    for group, pair in enumerate((near, far)):
        for walks in (False, True):
            for f, x in enumerate(pair, 1):
                rows.append((group, 0, walks, f, f, len(x), 1 << 60, 180, sketch(x)))
    assert sorted(screened(rows)) == [(False, 1), (False, 2), (True, 1), (True, 2)]
    assert len(screened([r[:2] + r[2:8] + (sketch(near[0]),) for r in rows])) == 8


def test_whole_sets_reads_the_texts_of_the_named_sets_only(spark):
    """The hash of a text is computed behind the join with the ids, not in a filter in front of it."""
    docs = spark.createDataFrame([(i, f"a b c d e f g {i}") for i in range(20)], "doc_id long, text string")
    keys = ngramjoin.checkpointed(ngramjoin.set_keys(docs))
    names = keys.filter("doc_id < 2").select("f")
    sets = ngramjoin.whole_sets(docs, keys, names, None)
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    python = [line for line in plan.splitlines() if "Python" in line or "MapInArrow" in line]
    assert len(python) == 1 and "MapInArrow" in python[0]
    assert {r.f for r in sets.collect()} == {r.f for r in names.collect()}


def test_prefix_rows_are_made_once(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f g {i}") for i in range(20)], "doc_id long, text string")
    order = spark.sparkContext.broadcast(ngramjoin.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    shared = ngramjoin.shared_prefixes(ngramjoin.prefix_rows(docs, order))
    assert shared._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
