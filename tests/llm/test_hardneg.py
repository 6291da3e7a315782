"""Packed products and hard negatives against plain arithmetic."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, anchor int"


def brute_force(rows, scale=256):
    """Rows (vec_id, embedding, label): the report's columns, sorted."""
    usable = []
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None:
            continue
        if any(x is None or math.isnan(x) or math.isinf(x * scale) for x in vector):
            continue
        usable.append((vec_id, [math.floor(scale * x) for x in vector], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for anchor, a, own in {(v, tuple(q), n): (v, q, n) for v, q, n in usable if v % 100 == 0}.values():
        scored = [(sum(x * y for x, y in zip(a, q)), v, n) for v, q, n in usable if v != anchor]
        order = sorted(scored, key=lambda s: (-s[0], s[1]))
        for score, positive, _ in [s for s in order if s[2] == own][:5]:
            near = [s for s in order if s[2] != own and 30 * score <= 100 * s[0] <= 90 * score][:10]
            out.extend((anchor, positive, k + 1, v, score, s) for k, (s, v, _) in enumerate(near))
    return sorted(out)


def test_report_equals_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = sorted(tuple(r) for r in hardneg.negatives_report(table).collect())
    assert got == brute_force([(r.vec_id, r.embedding, r.label) for r in table.collect()]) and got


@pytest.mark.parametrize("huge", [1.0, 1e6])
def test_odd_rows_and_small_blocks(spark, huge):
    """Ties, copies, nulls, short and huge vectors; huge ones are packed in Python integers."""
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.5]) * huge for _ in range(6)], rng.randrange(3)) for i in range(400)]
    rows += [rows[7]] * 30 + [(100, [0.5, None], 1), (200, [float("nan")], 1), (300, None, 1), (401, [0.5], None), (None, [0.5], 1)]
    rows += [(500, [0.5 * huge], 0), (501, [], 0), (600, [float("inf")], 2), (-100, [0.5 * huge, 0.5 * huge], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    wanted = df.select("vec_id", moved.alias("label"), F.col("embedding").alias("vector"))
    small = hardneg.hard_negatives(wanted, F.col("vec_id") % 100 == 0, anchor_block=2, row_block=64)
    assert sorted(tuple(r) for r in small.collect()) == brute_force(rows)
    assert sorted(tuple(r) for r in hardneg.negatives_report(df).collect()) == brute_force(rows)


def test_scores_beyond_a_long_end_no_job(spark):
    rows = [(i, [1e30 * (1 + i), -1e300], i % 2, "x", 1) for i in range(300)]
    assert hardneg.negatives_report(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_empty_table(spark):
    assert hardneg.negatives_report(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("size,limit", [(64, 256), (64, 20_000), (3, 1), (512, 5), (4, 2**40), (1, 0)])
def test_packed_products_are_exact(size, limit):
    rng = np.random.default_rng(size)
    rows = rng.integers(-limit, limit + 1, (37, size))
    anchors = rng.integers(-limit, limit + 1, (11, size))
    rows[0], anchors[0] = -limit, limit  # the extremes
    packed = hardneg.Packed(rows, int(np.abs(anchors).sum(axis=1).max()))
    assert packed.wide == (limit == 2**40) and (packed.fields > 1 or limit >= 20_000)
    want = anchors.astype(object) @ rows.astype(object).T
    assert (packed.scores(anchors) == want).all()
