"""Merges into the table in parts against the upsert of the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.operators import failures
from faultline.sources import parted
from faultline.sources.checkpoints import checkpointed

SEEN = 1_700_000_000_000


def table(spark, numbers, seen=SEEN, repo="a/b"):
    """Failure rows of the given ids; every other column has a value of its type."""
    values = {"string": F.lit("x"), "bigint": F.lit(1), "double": F.lit(0.5), "boolean": F.lit(False)}
    rows = spark.createDataFrame([(f"f{n}", n) for n in numbers], "id string, n int")
    columns = {
        "id": F.col("id"), "repo": F.lit(repo), "last_seen_at": F.lit(seen) + F.col("n"),
        "embedding": F.array(F.col("n").cast("float")), "cited_failure_ids": F.array(F.col("id")),
    }
    return S.conform(
        rows.select(*[columns.get(f.name, values.get(f.dataType.simpleString(), F.lit(None))).alias(f.name) for f in S.FAILURES]), S.FAILURES
    )


def content(df):
    return sorted(str(tuple(r)) for r in df.select(*[f.name for f in S.FAILURES]).collect())


@pytest.mark.parametrize("limit", [parted.MERGE_ROWS, 0])
def test_merges_equal_upserts(spark, scratch, monkeypatch, limit):
    """Small change sets by broadcast and large ones by shuffle, several in a row, with repeated ids."""
    monkeypatch.setattr(parted, "MERGE_ROWS", limit)
    rng = random.Random(4)
    whole = table(spark, range(300))
    manifest = parted.write_table(whole, f"{scratch}/t", part_rows=20)
    assert content(parted.read_table(spark, manifest)) == content(whole)
    for k in range(2):
        numbers = [rng.randrange(400) for _ in range(12)]
        incoming = table(spark, numbers, SEEN + 10_000 * (k + 1), "new/repo").withColumn("seq", F.monotonically_increasing_id())
        incoming = checkpointed(incoming)
        whole = failures.upsert_failures(whole, incoming)
        manifest = parted.merge(spark, manifest, incoming, f"{scratch}/t")
        assert content(parted.read_table(spark, manifest)) == content(whole)


def test_only_named_parts_are_written(spark, scratch):
    manifest = parted.write_table(table(spark, range(300)), f"{scratch}/t", part_rows=20)
    before, parts = parted.read_manifest(spark, manifest)
    changed = table(spark, [3, 7], SEEN + 5).withColumn("seq", F.lit(1))
    named = parted.parts_named(spark, manifest, changed)
    after, same = parted.read_manifest(spark, parted.merge(spark, manifest, changed, f"{scratch}/t"))
    assert parts == same == 15 and 1 <= len(named) <= 2
    assert {p for p in before if before[p] != after[p]} == named
    assert content(parted.read_table(spark, manifest)) == content(table(spark, range(300)))  # the old state still holds


def test_snapshot_rows_are_not_shuffled(spark, scratch):
    manifest = parted.write_table(table(spark, range(50)), f"{scratch}/t", part_rows=10)
    fresh = failures.arrivals(table(spark, [1, 60]).withColumn("seq", F.lit(1)), [f.name for f in S.FAILURES])
    fresh = checkpointed(fresh)
    refreshed, new = parted.merged(parted.read_table(spark, manifest), fresh, True)
    refreshed.collect()
    plan = refreshed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert [r.id for r in new.collect()] == ["f60"]


def test_odd_tables(spark, scratch):
    empty = parted.write_table(table(spark, []), f"{scratch}/e")
    assert parted.read_table(spark, empty).count() == 0
    assert parted.merge(spark, empty, table(spark, []).withColumn("seq", F.lit(1)), f"{scratch}/e") == empty
    filled = parted.merge(spark, empty, table(spark, [1, 1, 2]).withColumn("seq", F.lit(1)), f"{scratch}/e")
    assert sorted(r.id for r in parted.read_table(spark, filled).collect()) == ["f1", "f2"]
    named = parted.read_named(spark, filled, spark.createDataFrame([("f1",), ("nobody",)], "id string"))
    assert "f1" in {r.id for r in named.collect()}


def test_a_part_is_written_by_several_tasks(spark, scratch):
    """Part by part, a table of few parts leaves most cores idle."""
    manifest = parted.write_table(table(spark, range(400)), scratch, 200)
    written = parted.read_table(spark, manifest)
    folders, parts = parted.read_manifest(spark, manifest)
    assert parts == len(folders) == 2 and len(written.inputFiles()) > 4
    assert sorted(int(r.id[1:]) for r in written.collect()) == list(range(400))
