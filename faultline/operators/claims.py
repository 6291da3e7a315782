"""Duplicate suppression: one winner per (repo, signature) and time window.

Input events: repo, signature_hash, failure_id, ts (epoch ms), kind (claim,
release or forget), event_id. Events of a key apply in (ts, event_id) order;
events without a time are left out.

Only few events change a claim, and from each of them the next one that does is
known without looking at those between: the first claim once the claim is stale
or the suppression over, a release by the holder before that, or a forget. So a
batch of sorted events is folded from change to change by binary search, and
the verdicts of all its rows follow from the change each row stands behind.

The events are sorted by range once, over all keys, so that every task has as
many rows as any other, whatever the keys; a key with a third of all rows lies
in many tasks. Each task first folds its rows as if no claim were held at its
start. That is exact for every key but the first, and for the first one too from
a forget, or a claim after a quiet gap, on: both clear what was before. What a
task cannot know is the claim its first key holds at its start. That claim is
carried over, one row per task where a key just crosses the border of two tasks.
Where a key fills whole tasks without a forget or gap, the carry passes over the
first claim of each millisecond and the releases, again from change to change.
With the claims at their starts all tasks fold their rows for good.
"""

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.functions.ordering import PARTITION_SHIFT
from faultline.sources.checkpoints import checkpointed

KEY = ["repo", "signature_hash"]
EVENT = [*KEY, "failure_id", "ts", "kind", "event_id"]
VERDICT = (
    "repo string, signature_hash string, failure_id string, ts long, kind string, event_id long,"
    " verdict string, holder string, claimed_at long, completed_at long"
)
STATE = "holder string, claimed_at long, completed_at long"
PASSED = "array<struct<ts:bigint,kind:string,failure_id:string>>"
HEAD = f"repo string, signature_hash string, part long, seq long, role string, {STATE}, passed {PASSED}"
CLAIM, RELEASE, FORGET = 0, 1, 2
NEVER = 1 << 62


def step(state, failure_id, ts, kind):
    """Next state and verdict; a state is (holder, claimed_at, completed_at) or None."""
    if state is not None:
        holder, claimed, completed = state
        expired = (
            ts - claimed >= S.STALE_CLAIM_MS
            if completed is None
            else ts - completed > S.CLAIM_RETENTION_MS
        )
        if expired:
            state = None
    if kind == "forget":
        return None, "forgotten", None
    if kind == "release":
        if state is None or state[0] != failure_id:
            return state, "not_holder", None
        return (failure_id, state[1], ts), "released", failure_id
    if state is not None:
        if state[2] is None:
            return state, "in_flight", state[0]
        if ts - state[2] < S.RECENT_TRIAGE_MS:
            return state, "recently_triaged", state[0]
    return (failure_id, ts, None), "new", failure_id


class Events:
    """A run of sorted events as arrays, with for each place the next one of every kind."""

    def __init__(self, ts: np.ndarray, kind: np.ndarray, failure: np.ndarray, segment: np.ndarray):
        """``failure``: a number per failure id; ``segment``: a number per key, ascending."""
        self.size = len(ts)
        self.ts, self.kind, self.failure, self.segment = ts, kind, failure, segment
        self.times = ts.tolist()
        places = np.arange(self.size)

        def following(found):
            at = np.append(np.where(found, places, NEVER), NEVER)
            return np.minimum.accumulate(at[::-1])[::-1].tolist()

        self.claim, self.forget = following(kind == CLAIM), following(kind == FORGET)
        # the next release of the same failure, in the order of key, failure and place
        order = np.lexsort((places, failure, segment))
        same = np.append((np.diff(failure[order]) == 0) & (np.diff(segment[order]) == 0), False)
        releases = np.where(kind[order] == RELEASE, np.arange(self.size), NEVER)
        later = np.append(np.minimum.accumulate(releases[::-1])[::-1][1:], NEVER)
        group = np.cumsum(np.append(False, ~same[:-1])) if self.size else places
        inside = later < NEVER
        inside[inside] = group[later[inside].astype(np.int64)] == group[inside]
        release = np.full(self.size, NEVER)
        release[order[inside]] = order[later[inside].astype(np.int64)]
        self.release = release.tolist()

    def segments(self) -> Iterator[tuple[int, int]]:
        bounds = np.flatnonzero(np.diff(self.segment)) + 1
        yield from zip([0, *bounds.tolist()], [*bounds.tolist(), self.size])

    def first_release(self, failure: int, end: int) -> int:
        found = np.flatnonzero((self.kind[:end] == RELEASE) & (self.failure[:end] == failure))
        return int(found[0]) if len(found) else NEVER

    def changes(self, start: int, end: int, state):
        """Places that change the claim, with the claim behind them, from ``state`` at ``start`` on.

        A state is (failure, claimed_at, completed_at) or None.
        """
        release = self.first_release(state[0], end) if state else NEVER
        place = start
        while place < end:
            if state is None:
                found = self.claim[place]
            else:
                failure, claimed, completed = state
                free = claimed + S.STALE_CLAIM_MS if completed is None else completed + S.RECENT_TRIAGE_MS
                found = self.claim[bisect_left(self.times, free, place, end)]
                if release < end:
                    since = self.times[release] - (claimed if completed is None else completed)
                    if since < S.STALE_CLAIM_MS if completed is None else since <= S.CLAIM_RETENTION_MS:
                        found = min(found, release)
                found = min(found, self.forget[place])
            if found >= end:
                return
            at, kind, failure = self.times[found], self.kind[found], int(self.failure[found])
            if kind == FORGET:
                state, release = None, NEVER
            elif kind == CLAIM:
                state, release = (failure, at, None), self.release[found]
            else:
                state, release = (failure, state[1], at), self.release[found]
            yield found, state
            place = found + 1

    def settled(self, start: int, end: int, before: int | None) -> int:
        """The first place whose outcome does not depend on what was held at ``start``."""
        ts = self.ts[start:end]
        gaps = np.diff(ts, prepend=ts[0] if before is None else before) >= S.RECENT_TRIAGE_MS
        kind = self.kind[start:end]
        clear = np.flatnonzero((kind == FORGET) | ((kind == CLAIM) & gaps))
        return start + int(clear[0]) if len(clear) else end


class Batch(Events):
    """The events of an Arrow batch; ``previous`` is the key the batch before ended with."""

    def __init__(self, batch: pa.RecordBatch, previous=None):
        self.batch = batch
        coded = [batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy() for c in KEY]
        new = np.zeros(batch.num_rows, dtype=bool)
        for codes in coded:
            new[1:] |= np.diff(codes) != 0
        failures = batch.column("failure_id").dictionary_encode(null_encoding="encode")
        self.names = failures.dictionary.to_pylist()
        kinds = batch.column("kind").to_pylist()
        kind = np.array([{"release": RELEASE, "forget": FORGET}.get(k, CLAIM) for k in kinds], dtype=np.int8)
        super().__init__(
            batch.column("ts").to_numpy(), kind, failures.indices.to_numpy().astype(np.int64), np.cumsum(new)
        )
        self.continues = previous is not None and self.key(0) == previous

    def key(self, place: int):
        return tuple(self.batch.column(c)[place].as_py() for c in KEY)

    def coded(self, state):
        """A named state in the numbers of this batch; a holder it does not know has none of them."""
        if state is None:
            return None
        code = self.names.index(state[0]) if state[0] in self.names else -1
        return (code, *state[1:])

    def named(self, state, held=None):
        if state is None:
            return None
        return (held[0] if state[0] == -1 else self.names[state[0]], *state[1:])

    def fold(self, held):
        """All changes, as (place, state), and the state at the end; ``held``: the state at the start."""
        found, state = [], None
        for start, end in self.segments():
            state = self.coded(held) if start == 0 and self.continues else None
            for change in self.changes(start, end, state):
                found.append(change)
                state = change[1]
        return found, self.named(state, held)


def non_empty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def table_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


HEAD_ARROW = pa.schema([
    ("repo", pa.string()), ("signature_hash", pa.string()), ("part", pa.int64()), ("seq", pa.int64()),
    ("role", pa.string()), ("holder", pa.string()), ("claimed_at", pa.int64()), ("completed_at", pa.int64()),
    ("passed", pa.list_(pa.struct([("ts", pa.int64()), ("kind", pa.string()), ("failure_id", pa.string())]))),
])
CARRIED_ARROW = pa.schema([
    ("part", pa.int64()), ("holder", pa.string()), ("claimed_at", pa.int64()), ("completed_at", pa.int64()),
])


def described(state) -> dict:
    return dict(zip(("holder", "claimed_at", "completed_at"), state or (None, None, None)))


def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the carry needs of one task: its first key takes a claim, its last key gives one.

    While the first key lasts and nothing has settled it, the events that could change
    a claim are passed on too.
    """
    first, previous, before, state, seq, open_ = None, None, None, None, 0, True
    for raw in non_empty(batches):
        batch = Batch(raw, previous)
        part = raw.column("_part")[0].as_py()
        _, state = batch.fold(state)
        if first is None:
            first = batch.key(0)
            yield table_of([{**dict(zip(KEY, first)), "part": part, "seq": 0, "role": "takes"}], HEAD_ARROW)
        if open_ and batch.key(0) == first:
            _, end = next(batch.segments())
            until = batch.settled(0, end, before)
            seq += 1
            yield table_of(
                [{**dict(zip(KEY, first)), "part": part, "seq": seq, "role": "passes", "passed": thinned(batch, until)}],
                HEAD_ARROW,
            )
            open_ = until == batch.size
        else:
            open_ = False
        previous, before = batch.key(batch.size - 1), batch.times[-1]
    if first is not None and not open_:
        row = {**dict(zip(KEY, previous)), "part": part, "seq": seq + 1, "role": "gives", **described(state)}
        yield table_of([row], HEAD_ARROW)


def thinned(batch: Batch, until: int) -> list[dict]:
    """The first claim of each millisecond and all releases, in order."""
    times, kinds = batch.ts[:until], batch.kind[:until]
    claims = np.flatnonzero(kinds == CLAIM)
    firsts = claims[np.append(True, np.diff(times[claims]) > 0)[: len(claims)]]
    kept = np.sort(np.append(firsts, np.flatnonzero(kinds == RELEASE))).tolist()
    return [
        {
            "ts": batch.times[k], "kind": "claim" if kinds[k] == CLAIM else "release",
            "failure_id": batch.names[batch.failure[k]],
        }
        for k in kept
    ]


def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The claim held at the start of each task, from the outlines sorted by key and task."""
    key, state = None, None
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            own = (row["repo"], row["signature_hash"])
            if own != key:
                key, state = own, None
            if row["role"] == "takes":
                if state is not None:
                    found.append({"part": row["part"], **described(state)})
            elif row["role"] == "gives":
                state = (row["holder"], row["claimed_at"], row["completed_at"]) if row["claimed_at"] is not None else None
            elif row["passed"]:
                passed = pa.RecordBatch.from_pylist([
                    {"repo": own[0], "signature_hash": own[1], **event} for event in row["passed"]
                ])
                _, state = Batch(passed, own).fold(state)
        yield table_of(found, CARRIED_ARROW)


def verdicts_of(batch: Batch, held):
    """Verdict, holder, claimed_at and completed_at of every row, and the state at the end."""
    found, state = batch.fold(held)
    at_start = batch.coded(held) if batch.continues else None
    places = [-1] + [p for p, _ in found]
    states = [at_start] + [s for _, s in found]
    behind = np.searchsorted(places, np.arange(batch.size), side="right") - 1
    place = np.array(places)[behind]
    known = np.array([s is not None for s in states])[behind]
    # a change only counts within its key
    known &= batch.segment == np.where(place < 0, 0, batch.segment[place])
    holder = np.array([s[0] if s else -1 for s in states])[behind]
    claimed = np.array([s[1] if s else 0 for s in states], dtype=np.int64)[behind]
    completed = np.array([-NEVER if s is None or s[2] is None else s[2] for s in states], dtype=np.int64)[behind]
    running = completed == -NEVER
    live = known & np.where(
        running, batch.ts - claimed < S.STALE_CLAIM_MS, batch.ts - np.where(running, 0, completed) <= S.CLAIM_RETENTION_MS
    )
    changed = place == np.arange(batch.size)
    is_claim = batch.kind == CLAIM
    verdict = np.select(
        [batch.kind == FORGET, is_claim & changed, is_claim & running, is_claim, changed],
        ["forgotten", "new", "in_flight", "recently_triaged", "released"], "not_holder",
    )
    names = pa.array([*batch.names, held[0] if held else None], pa.string())
    shown = is_claim | (changed & (batch.kind == RELEASE))
    codes = pa.array(np.where(holder < 0, len(batch.names), holder), pa.int64(), mask=~shown)
    columns = [
        pa.array(verdict.tolist(), pa.string()), names.take(codes),
        pa.array(claimed, pa.int64(), mask=~live), pa.array(completed, pa.int64(), mask=~live | running),
    ]
    return columns, state


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The verdicts of one task, from the claim held at its start."""
    previous, state = None, None
    for raw in non_empty(batches):
        if previous is None and raw.column("claimed_at")[0].is_valid:
            state = tuple(raw.column(c)[0].as_py() for c in ("holder", "claimed_at", "completed_at"))
            previous = tuple(raw.column(c)[0].as_py() for c in KEY)
        batch = Batch(raw, previous)
        columns, state = verdicts_of(batch, state if batch.continues else None)
        previous = batch.key(batch.size - 1)
        yield pa.RecordBatch.from_arrays(
            [raw.column(c) for c in EVENT] + columns,
            names=[*EVENT, "verdict", "holder", "claimed_at", "completed_at"],
        )


def claim_verdicts(events: DataFrame) -> DataFrame:
    """Every event with its verdict, the holder it met and the claim state after it.

    The sorted events are checkpointed, as a lost executor must not move the borders of
    the tasks. The claims carried are at most one row per task, so they are broadcast.
    """
    timed = events.select(*EVENT).filter("ts IS NOT NULL")
    ordered = timed.sort(*KEY, "ts", "event_id", "kind", "failure_id")
    part = F.shiftright(F.monotonically_increasing_id(), PARTITION_SHIFT)
    rows = checkpointed(ordered.withColumn("_part", part))
    heads = rows.mapInArrow(outline, HEAD)
    carried = heads.repartition(*KEY).sortWithinPartitions(*KEY, "part", "seq").mapInArrow(
        carry, f"part long, {STATE}"
    )
    held = rows.join(F.broadcast(carried.withColumnRenamed("part", "_part")), "_part", "left")
    return held.mapInArrow(answer, VERDICT)


def current_claims(verdicts: DataFrame) -> DataFrame:
    """Last claim state of each key; forgotten keys are absent."""
    order = F.struct("ts", "event_id")
    changed = F.col("verdict").isin("new", "released", "forgotten")
    state = F.struct("holder", "claimed_at", "completed_at")
    last = verdicts.filter(changed).groupBy(*KEY).agg(F.max_by(state, order).alias("s"))
    return last.filter("s.claimed_at IS NOT NULL").select(
        *KEY, F.col("s.holder").alias("failure_id"), "s.claimed_at", "s.completed_at"
    )
