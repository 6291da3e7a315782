import json
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.operators import claims, fingerprint, history, ingest
from faultline.sources import tables
from faultline.streaming import approvals as live_approvals
from faultline.streaming import claims as live_claims
from faultline.streaming import counters
from faultline.streaming import history as live_history
from faultline.streaming import ingest as live
from tests.test_claims import SCHEMA, random_events

NOW = 1_704_100_000_000

pytestmark = pytest.mark.usefixtures("two_partitions")


def stream_of(spark, batches, schema, path):
    """A file stream that serves one file per micro-batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{path}/in")


def run(df, path, mode="append", sink=None):
    writer = df.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).outputMode(mode)
    query = (writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", f"{path}/out")).start()
    assert query.awaitTermination(240)
    if query.exception():
        raise query.exception()


def bodies(n):
    ok = {"workflow_run": {"id": 1, "status": "completed", "conclusion": "failure"}, "repository": {"full_name": "a/b"}}
    out = []
    for i in range(n):
        body = [
            {**ok, "logs": f"FAIL src/m{i % 3}.test.ts\n  ● case {i % 3} fails"},
            {"repo": "a/c", "log": f"connect ECONNREFUSED 10.0.0.{i}:80"},
            {"object_kind": "pipeline", "object_attributes": {"status": "success"}},
        ][i % 3]
        out.append((f"d{i}", NOW + i * 1000, {}, json.dumps(body) if i % 7 else "broken"))
    return out


def test_ingest_stream_equals_batch(spark, scratch):
    rows = bodies(40)
    stream = stream_of(spark, [rows[:20], rows[20:], rows[15:25]], S.DELIVERIES, scratch)
    changes = f"{scratch}/changes"
    run(live.accepted(live.once(stream)), scratch, sink=live.ChangeWriter(changes))
    table = tables.current_failures(spark, None, changes)
    got = {r.id: r for r in table.collect()}
    snapshot, batches = tables.compacted(spark, None, changes, f"{scratch}/failures")
    assert batches == sorted(int(d.removeprefix("batch=")) for d in os.listdir(changes) if d.startswith("batch="))
    assert tables.read_failures(spark, snapshot).count() == len(got)
    again = tables.current_failures(spark, snapshot, changes)
    assert again.count() == len(got)

    some = sorted(got)[:3]
    notes = spark.createDataFrame([(i, " fixed ", NOW, "w") for i in some] + [("nobody", "x", NOW, "w")], "id string, note string, at long, workflow_id string")
    sink = live.ResolutionWriter(f"{scratch}/resolved", f"{scratch}/runs", lambda batch: table)
    sink(notes, 0)
    sink(notes, 0)
    closed = tables.current_failures(spark, snapshot, changes, f"{scratch}/resolved")
    assert sorted(r.id for r in closed.filter("status = 'resolved' AND resolution_note = 'fixed'").collect()) == some
    assert sorted(r.failure_id for r in tables.read_runs(spark, f"{scratch}/runs").collect()) == some
    batch = live.accepted(spark.createDataFrame(rows, S.DELIVERIES))
    want = {r.delivery_id: r for r in batch.collect()}
    assert set(got) == set(want) and len(got) > 15
    assert all(got[i].signature_hash == want[i].hash and got[i].occurrence_count == 1 for i in got)
    refused = live.refused(spark.createDataFrame(rows, S.DELIVERIES))
    assert refused.count() + len(want) == 40


FAR = [("end", "end", "end", NOW + 10_000 * S.DAY_MS, "claim", -1)]  # moves the watermark past all other events


def answers(spark, batches, path, **options):
    """The verdicts of all events in the batches, read when the watermark has passed them."""
    run(live_claims.claim_verdicts(stream_of(spark, [*batches, FAR], SCHEMA, path), **options), path)
    return {r.event_id: r for r in spark.read.parquet(f"{path}/out").collect() if r.repo != "end"}


def test_claim_stream_equals_batch(spark, scratch):
    events = sorted(random_events(11, 120, 2000), key=lambda e: (e[3], e[5]))
    cut = [events[: len(events) // 3], events[len(events) // 3 : 200], events[200:]]
    got = {i: r.verdict for i, r in answers(spark, cut, scratch).items()}
    want = {r.event_id: r.verdict for r in claims.claim_verdicts(spark.createDataFrame(events, SCHEMA)).collect()}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_claims_in_any_order_and_cut(spark, scratch, seed):
    """Rows out of order within the lateness, also across micro-batches, equal times and ids included."""
    rng = random.Random(seed)
    events = random_events(seed, 150, 300, ties=True)
    events += [events[3], (*events[5][:4], "forget", events[5][5])]
    lateness = 40 * S.MINUTE_MS
    order = sorted(events, key=lambda e: e[3] + rng.randrange(lateness))
    cut, batches = sorted(rng.sample(range(1, len(order)), 6)), []
    for start, end in zip([0, *cut], [*cut, len(order)]):
        batches.append(rng.sample(order[start:end], end - start))
    run(live_claims.claim_verdicts(stream_of(spark, [*batches, FAR], SCHEMA, scratch), lateness), scratch)
    stream = spark.read.parquet(f"{scratch}/out").filter("repo <> 'end'")
    batch = claims.claim_verdicts(spark.createDataFrame(events, SCHEMA))
    columns = batch.columns
    assert sorted(map(str, stream.select(columns).collect())) == sorted(map(str, batch.collect()))


def test_late_claims_are_answered_apart(spark, scratch):
    minute = S.MINUTE_MS
    first = [("r", "h", "a", NOW, "claim", 1), ("r", "h", "a", NOW + minute, "release", 2), ("r", "x", "b", NOW + 40 * minute, "claim", 3)]
    second = [("r", "h", "c", NOW + 20 * minute, "claim", 4), ("r", "h", "d", NOW + 41 * minute, "claim", 5)]
    got = {i: r.verdict for i, r in answers(spark, [first, second], scratch).items()}
    assert got == {1: "new", 2: "released", 3: "new", 4: "late", 5: "new"}


def test_approval_gate(spark, scratch):
    minute = S.MINUTE_MS
    pending = [("a", NOW), ("b", NOW), ("c", NOW)]
    later = [("z", NOW + 600 * minute)]
    decided = [
        ("a", True, None, "r", NOW + 5 * minute, 1), ("a", False, None, "r", NOW + 9 * minute, 2),
        ("b", False, None, "r", NOW + 60 * minute, 3), ("c", True, None, "r", NOW + 61 * minute, 4),
    ]
    end = [("z", True, None, "r", NOW + 600 * minute, 5)]
    p = stream_of(spark, [pending, later], "failure_id string, pending_at long", f"{scratch}/p")
    a = stream_of(
        spark, [decided, end],
        "failure_id string, approved boolean, edited_fix string, reviewer string, ts long, event_id long", f"{scratch}/a",
    )
    run(live_approvals.gate(p, a), scratch)
    out = live_approvals.first_per_failure(spark.read.parquet(f"{scratch}/out"))
    got = {r.failure_id: r.approval for r in out.collect()}
    assert {k: got[k] for k in "abc"} == {"a": "approved", "b": "rejected", "c": "timed_out"}


def test_counters(spark, scratch):
    schema = "repo string, signature_hash string, signature_text string, status string, occurrence_count long, last_seen_at long"
    rows = [("r", "h", "t", "resolved" if i % 3 == 0 else "open", 1, NOW + i * S.HOUR_MS) for i in range(60)]
    seen = {}

    def keep(batch, _):
        seen.update({r.repo: (r.total_failures, r.total_resolved, r.last_failure_at) for r in batch.collect()})

    run(counters.live_counters(stream_of(spark, [rows[30:], rows[:30]], schema, f"{scratch}/1")), f"{scratch}/1", "update", keep)
    assert seen == {"r": (60, 20, NOW + 59 * S.HOUR_MS)}
    days = rows + [("r", "h", "t", "open", 1, NOW + 900 * S.HOUR_MS)]
    run(counters.daily_signatures(stream_of(spark, [rows, days[-1:], days[-1:]], schema, f"{scratch}/2")), f"{scratch}/2")
    closed = spark.read.parquet(f"{scratch}/2/out")
    total = counters.counts_from_days(closed, F.timestamp_millis(F.lit(0))).first()
    assert (total.open_count, total.resolved_count) == (40, 20)


@pytest.mark.parametrize("seed", [5, 6])
def test_claims_in_flight(spark, scratch, seed):
    """After a replay up to ``now``: the claims in flight that the batch counts then."""
    rng, minute = random.Random(seed), S.MINUTE_MS
    now, lateness = 290 * minute, 5 * minute
    events = [e for e in random_events(seed, 150, 300) if e[3] < now]
    events += [("r0", "edge", "f", now - 10 * minute, "claim", -2), ("r0", "gone", "f", now - 10 * minute - 1, "claim", -3)]
    order = sorted(events, key=lambda e: e[3] + rng.randrange(lateness))
    end = [("end", "end", "end", now + lateness, "claim", -1)]
    seen = {}

    def keep(batch, _):
        seen.update({r.repo: r.in_flight for r in batch.collect()})

    stream = stream_of(spark, [order[:90], order[90:200], order[200:], end], SCHEMA, scratch)
    run(counters.live_in_flight(stream, lateness), scratch, "update", keep)
    held = claims.current_claims(claims.claim_verdicts(spark.createDataFrame(events, SCHEMA)))
    live = F.col("completed_at").isNull() & (F.col("claimed_at") >= now - 10 * minute)
    want = {r.repo: r.n for r in held.groupBy("repo").agg(F.count_if(live).alias("n")).collect()}
    assert {k: v for k, v in seen.items() if v} == {k: v for k, v in want.items() if v}


def test_history_of_any_cut(spark, scratch):
    rng = random.Random(9)
    schema = "repo string, id long, role string, content string, created_at long"
    rows = [("a", i, "user", "x" * (9000 if i == 290 else 3), i) for i in range(300)] + [("b", i, None, None, None) for i in range(5)]
    rows += [(None, 7, "assistant", "y", 1), ("c", None, "user", "old", 1)]
    rng.shuffle(rows)
    stream = stream_of(spark, [rows[:3], rows[3:120], rows[120:290], rows[290:]], schema, scratch)
    run(live_history.trim_history(stream), scratch)
    versions = spark.read.parquet(f"{scratch}/out")
    got = live_history.latest(versions)
    want = history.trim_history(spark.createDataFrame(rows, schema))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert versions.groupBy("repo", "version").count().agg(F.max("count")).first()[0] == 50


class Store:
    """The state of one key in memory, which counts the calls."""

    def __init__(self):
        self.calls, self.timers, self.states = 0, set(), {}

    def getValueState(self, name, *schemas):
        return self.states.setdefault(name, OneState(self))

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class OneState:
    def __init__(self, store):
        self.store, self.values = store, {}

    def called(self):
        self.store.calls += 1
        return self.values

    def exists(self):
        return None in self.called()

    def get(self):
        return self.called()[None]

    def update(self, value):
        self.called()[None] = value

    def clear(self):
        self.called().clear()

    def containsKey(self, key):
        return key in self.called()

    def getValue(self, key):
        return self.called()[key]

    def updateValue(self, key, value):
        self.called()[key] = value

    def removeKey(self, key):
        del self.called()[key]

    def iterator(self):
        return iter(list(self.called().items()))

    def keys(self):
        return iter(list(self.called()))


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def replayed_in_memory(processor, batches):
    """What a processor gives for one key; a batch is (rows, watermark before it, watermark behind it)."""
    store, out = Store(), []
    processor.init(store)
    for rows, before, behind in batches:
        out += processor.handleInputRows(("r", "h"), iter(rows), Clock(before))
        while store.timers and min(store.timers) <= behind:
            at = min(store.timers)
            store.timers.remove(at)
            out += processor.handleExpiredTimer(("r", "h"), Clock(behind), Clock(at))
    return out, store


@pytest.mark.parametrize("held", [10_000, 7])
def test_claims_need_few_calls_to_the_state(monkeypatch, held):
    """The time of a stream goes into calls to the state; also with spans cut down to a millisecond."""
    monkeypatch.setattr(live_claims, "HELD", held)
    rng, minute = random.Random(3), S.MINUTE_MS
    kinds = ["claim", "claim", "release", "forget"]
    rows = [Row(ts=NOW + rng.randrange(300) * minute // 7, event_id=i, failure_id=f"f{i % 5}", kind=kinds[rng.randrange(4)]) for i in range(3000)]
    rows += [Row(ts=NOW + 4 * minute, event_id=None if i < 4 else i, failure_id=f"f{i % 3}", kind="claim") for i in range(60)]
    rng.shuffle(rows)
    middle = NOW + 20 * minute + 11
    early = [r for r in rows if r.ts < middle or r.event_id % 2]
    late = [r for r in rows if not (r.ts < middle or r.event_id % 2)]
    out, store = replayed_in_memory(live_claims.ClaimProcessor(), [(early, NOW, middle), (late, middle, NOW + 9 * S.DAY_MS)])
    state, want = None, []
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id is not None, r.event_id or 0, r.kind, r.failure_id)):
        state, verdict, holder = claims.step(state, r.failure_id, r.ts, r.kind)
        want.append((r.ts, r.event_id, r.failure_id, verdict, holder))
    assert [(r.ts, r.event_id, r.failure_id, r.verdict, r.holder) for r in out] == want
    assert not any(s.values for s in store.states.values())
    if held > len(rows):
        assert store.calls < len(rows) / 10


def test_state_has_no_more_parts_than_cores(spark):
    from faultline.plans.replay import PARTITIONS, state_store

    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, "200")
    try:
        with state_store(spark):
            assert int(spark.conf.get(PARTITIONS)) <= max(spark.sparkContext.defaultParallelism, 2)
        assert spark.conf.get(PARTITIONS) == "200"
    finally:
        spark.conf.set(PARTITIONS, before)


def test_repeats_need_few_calls_to_the_state():
    hour = S.HOUR_MS
    row = lambda i, at: Row(delivery_id=i, received_at=at)
    ids = [None, *[f"d{i}" for i in range(5000)]]
    first = [row(i, NOW + (k % 9) * hour) for k, i in enumerate(ids)]
    batches = [
        (first + first[:40], 0, NOW),
        (first[::3] + [row("new", NOW)], NOW, NOW + 3 * hour + 1),  # forgets what came in the first three hours
        (first, NOW + 3 * hour + 1, NOW + 99 * hour),
    ]
    out, store = replayed_in_memory(live.OnceProcessor(hour, ["delivery_id", "received_at"]), batches)
    again = [r for k, r in enumerate(first) if k % 9 <= 2]
    assert out == first + [row("new", NOW)] + again
    assert store.calls < len(first) / 2 and not any(s.values for s in store.states.values())
