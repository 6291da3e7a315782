"""Claim events pass between Spark and the processor many in a row, with the verdicts of single ones."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import Row

from faultline import schemas as S
from faultline.operators import claims
from faultline.streaming import claims as live
from tests.test_claims import SCHEMA, folded, random_events
from tests.test_streaming import NOW, answers, replayed_in_memory

COLUMNS = ["repo", "signature_hash", "failure_id", "ts", "kind", "event_id"]


def batches_of(events, rows):
    for start in range(0, len(events), rows):
        some = [dict(zip(COLUMNS, e, strict=True)) for e in events[start : start + rows]]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_pylist(some, schema=pa.schema(list(zip(COLUMNS, types, strict=True))))


@pytest.mark.parametrize("held", [100_000, 500])
def test_few_rows_for_many_events(monkeypatch, held):
    monkeypatch.setattr(live, "HELD", held)
    rng, minute = random.Random(4), S.MINUTE_MS
    kinds = ["claim", "claim", "release", "forget", None]
    events = [("r", "h", f"f{i % 5}", NOW + rng.randrange(3000 * minute), kinds[rng.randrange(5)], i) for i in range(20_000)]
    rows = [r for b in live.pack(batches_of(events, 1000)) for r in b.to_pylist()]
    assert max(r["ts"] for r in rows) == max(e[3] for e in events)
    out, store = replayed_in_memory(live.PackedClaimProcessor(), [([Row(**r) for r in rows], NOW, NOW + 9 * S.DAY_MS)])
    assert len(rows) <= len(events) / held + 1
    if held > len(events):
        assert len(out) < len(events) / 100 and store.calls < len(events) / 20
    given = pa.RecordBatch.from_pylist([r.asDict() for r in out])
    told = {r["event_id"]: r for b in live.unpack([given]) for r in b.to_pylist()}
    got = {i: (r["verdict"], r["holder"], r["claimed_at"], r["completed_at"]) for i, r in told.items()}
    assert got == folded(events) and all(tuple(told[e[5]][c] for c in COLUMNS) == e for e in events)


def test_keys_are_packed_apart():
    events = [(r, h, None if i % 3 else "f", None if i % 5 == 0 else NOW - i, None, i) for i, (r, h) in enumerate([(None, "h"), ("r", None), ("r", "h"), (None, None)] * 9)]
    rows = [r for b in live.pack(batches_of(events, 7)) for r in b.to_pylist()]
    assert len(rows) == 4
    back = [(r["repo"], r["signature_hash"], *e.values()) for r in rows for e in live.unpacked(r["packed"], live.EVENTS).to_pylist()]
    assert sorted(map(str, back)) == sorted(map(str, events))
    assert list(live.pack(iter([]))) == [] and list(live.unpack(iter([]))) == []


@pytest.mark.usefixtures("two_partitions")
def test_odd_events_on_a_stream(spark, scratch):
    """Null keys, failures, kinds and times; ids beyond what a double holds."""
    big = 2**60 + 1
    events = [
        (None, "h", None, NOW, "claim", big), (None, "h", None, NOW + 2, "release", big + 1), ("r", None, "a", NOW, None, 3),
        ("r", None, "b", NOW, "claim", 4), ("r", "h", "a", None, "claim", 5), ("r", "h", "a", NOW + 9, "release", 6),
    ]
    events += [e for e in random_events(7, 60, 500) if e[5] > 6]
    events = [e if e[3] is None or e[3] >= NOW else (*e[:3], NOW + e[3], *e[4:]) for e in events]
    got = answers(spark, [events], scratch, lateness_ms=S.DAY_MS)
    want = {r.event_id: r for r in claims.claim_verdicts(spark.createDataFrame(events, SCHEMA)).collect()}
    assert got.pop(5).verdict == "late" and got == want
