import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import claims

MINUTE = 60_000


def brute_force(events):
    """Verdict per event_id, one key at a time, straight from the rule."""
    out, state = {}, {}
    for repo, signature, failure, ts, kind, event in sorted(events, key=lambda e: (e[3], e[5])):
        key = (repo, signature)
        held = state.get(key)
        if held and held["done"] is None and ts - held["at"] >= 10 * MINUTE:
            held = None
        elif held and held["done"] is not None and ts - held["done"] > 24 * 60 * MINUTE:
            held = None
        if kind == "forget":
            held, verdict = None, "forgotten"
        elif kind == "release":
            if held and held["by"] == failure:
                held = {**held, "done": ts}
                verdict = "released"
            else:
                verdict = "not_holder"
        elif held and held["done"] is None:
            verdict = "in_flight"
        elif held and ts - held["done"] < 15 * MINUTE:
            verdict = "recently_triaged"
        else:
            held, verdict = {"by": failure, "at": ts, "done": None}, "new"
        state[key] = held
        out[event] = verdict
    return out


def random_events(seed, n, span_minutes, hot=0.4, ties=False):
    rng, events = random.Random(seed), []
    for i in range(n):
        key = 0 if rng.random() < hot else rng.randrange(1, 6)
        ts = rng.randrange(span_minutes) * MINUTE if ties else rng.randrange(span_minutes * MINUTE)
        failure = f"f{i}"
        events.append((f"r{key % 3}", f"h{key}", failure, ts, "claim", 4 * i))
        for j in range(rng.choice([0, 1, 1, 2])):
            later = ts + rng.randrange(30) * MINUTE
            events.append((f"r{key % 3}", f"h{key}", failure, later, "release", 4 * i + 1 + j))
        if rng.random() < 0.03:
            events.append((f"r{key % 3}", f"h{key}", failure, ts + MINUTE, "forget", 4 * i + 3))
    return events


SCHEMA = "repo string, signature_hash string, failure_id string, ts long, kind string, event_id long"


@pytest.mark.parametrize("seed,n,span,ties", [(1, 300, 3000, False), (2, 600, 1500, True), (3, 400, 100000, False)])
def test_batch_matches_brute_force(spark, seed, n, span, ties):
    events = random_events(seed, n, span, ties=ties)
    df = spark.createDataFrame(events, SCHEMA).repartition(5)
    got = {r.event_id: r.verdict for r in claims.claim_verdicts(df).collect()}
    assert got == brute_force(events)


def folded(events):
    """Verdict, holder and claim of every event, one event after the other."""
    out, states = {}, {}
    for repo, signature, failure, ts, kind, event in sorted(events, key=lambda e: (e[3], e[5])):
        key = repo, signature
        states[key], verdict, holder = state, _, _ = claims.step(states.get(key), failure, ts, kind)
        out[event] = verdict, holder, *(state[1:] if state else (None, None))
    return out


def one_key(seed, n, pause, released, forgotten):
    """Claims of one key, ``pause`` ms apart at most, some released (also again) or forgotten."""
    rng, events, ts = random.Random(seed), [], 0
    for i in range(n):
        ts += rng.randrange(pause)
        events.append(("r", "hot", f"f{i}", ts, "claim", 10 * i))
        if rng.random() < released:
            for j in range(rng.choice([1, 1, 2, 5])):
                events.append(("r", "hot", f"f{i}", ts + rng.randrange(20) * MINUTE, "release", 10 * i + 1 + j))
        if rng.random() < forgotten:
            events.append(("r", "hot", f"f{i}", ts, "forget", 10 * i + 9))
    return events


@pytest.mark.parametrize("rows", [10_000, 50])
@pytest.mark.parametrize(
    "n,pause,released,forgotten", [(1500, 2000, 0.5, 0), (1500, 60_000, 0.7, 0.01), (2000, 100, 0.1, 0), (1500, 30_000, 0.3, 0.3)]
)
def test_one_key_in_many_tasks(spark, n, pause, released, forgotten, rows):
    """A key that fills whole tasks, with and without what settles a claim, in small batches too."""
    events = one_key(n + rows, n, pause, released, forgotten) + [("a", "b", "x", 5, "claim", -1), ("z", "b", "x", 5, "claim", -2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        answered = claims.claim_verdicts(spark.createDataFrame(events, SCHEMA).repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.event_id: (r.verdict, r.holder, r.claimed_at, r.completed_at) for r in answered} == folded(events)


def test_odd_events(spark):
    events = [
        (None, "h", None, 1, "claim", 1), (None, "h", None, 2, "release", 2), ("r", None, "a", 1, "claim", 3),
        ("r", None, "b", 1, "claim", 3), ("r", "h", "a", None, "claim", 4), ("r", "h", "a", 9, "release", None),
    ]
    rows = claims.claim_verdicts(spark.createDataFrame(events, SCHEMA)).collect()
    got = sorted((str(r.event_id), str(r.failure_id), r.verdict, str(r.holder)) for r in rows)
    assert got == [
        ("1", "None", "new", "None"), ("2", "None", "released", "None"), ("3", "a", "new", "a"),
        ("3", "b", "in_flight", "a"), ("None", "a", "not_holder", "None"),
    ]
    assert claims.claim_verdicts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_burst_has_one_winner(spark):
    events = [("r", "h", f"f{i}", 1000 + i, "claim", i) for i in range(12)]
    rows = claims.claim_verdicts(spark.createDataFrame(events, SCHEMA)).collect()
    assert sorted(r.verdict for r in rows) == ["in_flight"] * 11 + ["new"]
    assert {r.holder for r in rows} == {"f0"}


def test_current_claims(spark):
    events = [
        ("r", "a", "f1", 0, "claim", 1), ("r", "a", "f1", MINUTE, "release", 2),
        ("r", "b", "f2", 0, "claim", 3), ("r", "b", "f2", MINUTE, "forget", 4),
        ("r", "c", "f3", 5, "claim", 5),
    ]
    verdicts = claims.claim_verdicts(spark.createDataFrame(events, SCHEMA))
    rows = {r.signature_hash: (r.failure_id, r.claimed_at, r.completed_at) for r in claims.current_claims(verdicts).collect()}
    assert rows == {"a": ("f1", 0, MINUTE), "c": ("f3", 5, None)}
