"""Rows hours and days late: what goes into a stream comes out of it."""

import pytest
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.streaming import counters
from faultline.streaming import ingest as live
from tests.test_streaming import NOW, answers, bodies, run, stream_of

pytestmark = pytest.mark.usefixtures("two_partitions")


def test_every_late_claim_is_answered(spark, scratch):
    hour = S.HOUR_MS
    batches = [
        [("r", "h", "a", NOW, "claim", 1)],
        [("r", "x", "b", NOW + 100 * hour, "claim", 2)],
        [("r", "y", "c", NOW + 101 * hour, "claim", 3)],
        [("r", "h", "d", NOW + 96 * hour, "claim", 4), ("r", "z", "e", NOW - 99 * hour, "claim", 5)],
    ]
    got = sorted((i, r.verdict) for i, r in answers(spark, batches, scratch).items())
    assert got == [(1, "new"), (2, "new"), (3, "new"), (4, "late"), (5, "late")]


def test_late_deliveries_are_kept(spark, scratch):
    rows = [(f"e{k}", NOW + t * S.HOUR_MS, *bodies(2)[1][2:]) for k, t in enumerate((0, 30, 60, 55, -300))]
    batches = [rows[:1], rows[1:2], rows[2:3], [rows[3], rows[4], rows[2]], [rows[4]]]
    stream = stream_of(spark, batches, S.DELIVERIES, scratch)
    run(live.once(stream), scratch)
    got = spark.read.parquet(f"{scratch}/out")
    assert sorted(r.delivery_id for r in got.collect()) == [f"e{k}" for k in range(5)]
    assert live.accepted(got).count() + live.refused(got).count() == 5


def test_days_hold_late_rows(spark, scratch):
    schema = "repo string, signature_hash string, signature_text string, status string, occurrence_count long, last_seen_at long"
    row = lambda day, status: ("r", "h", "t", status, 2, NOW + day * S.DAY_MS)
    batches = [[row(0, "open"), row(0, "resolved")], [row(20, "open")], [row(40, "open")], [row(0, "open"), row(3, "resolved")], [row(60, "open")], [row(60, "open")]]
    run(counters.daily_signatures(stream_of(spark, batches, schema, scratch)), scratch)
    days = spark.read.parquet(f"{scratch}/out")
    total = counters.counts_from_days(days, F.timestamp_millis(F.lit(0))).first()
    assert (total.open_count, total.resolved_count) == (4, 2)
    assert days.agg(F.sum("occurrence_count")).first()[0] == 12
