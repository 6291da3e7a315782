"""Duplicate suppression on a stream, with the same rule as the batch operator.

A row that passes between Spark and a processor costs far more than an event, so the
streams put many events into one row: tasks pack what they have read by key before the
shuffle, the state holds packed events, and the verdicts are unpacked behind the
processor. A packed value is one Arrow record batch, compressed.
"""

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from faultline import schemas as S
from faultline.operators.claims import EVENT, KEY, VERDICT, Batch, verdicts_of
from faultline.streaming.late import watermarked

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "holder string, claimed_at long, completed_at long"
HELD = 100_000  # events in Python at once, of a key or of a task that packs them
WIDTHS = [S.HOUR_MS, S.MINUTE_MS, 1000, 1]  # of the spans in which events wait
EVENTS = pa.schema([("failure_id", pa.string()), ("ts", pa.int64()), ("kind", pa.string()), ("event_id", pa.int64())])
ANSWER = [("verdict", pa.string()), ("holder", pa.string()), ("claimed_at", pa.int64()), ("completed_at", pa.int64())]
ANSWERED = pa.schema([*EVENTS, *map(pa.field, *zip(*ANSWER))])
PACKED = "repo string, signature_hash string, ts long, packed binary"
# the batch operator's order: nulls first, then kind and failure among equal ids
ORDER = [(name, "ascending") for name in ("ts", "event_id", "kind", "failure_id")]
CODEC = "lz4"


def packed(batch: pa.RecordBatch) -> bytes:
    raw = batch.serialize()
    return raw.size.to_bytes(8, "little") + pa.compress(raw, CODEC, asbytes=True)


def unpacked(value: bytes, schema: pa.Schema) -> pa.RecordBatch:
    raw = pa.decompress(bytes(value[8:]), int.from_bytes(value[:8], "little"), CODEC)
    return pa.ipc.read_record_batch(raw, schema)


def groups(codes: np.ndarray) -> Iterator[np.ndarray]:
    """The places of equal codes, group by group."""
    order = np.argsort(codes, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(codes[order])) + 1)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many rows."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.concat_batches(held)
            held, count = [], 0
    if count:
        yield pa.concat_batches(held)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The events of a task by key, many in one row; ``ts`` is their latest time."""
    for batch in gathered(batches, HELD):
        coded = [batch.column(c).dictionary_encode(null_encoding="encode") for c in KEY]
        codes = [c.indices.to_numpy().astype(np.int64) for c in coded]
        events = pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in EVENTS], schema=EVENTS)
        places = list(groups(codes[0] * len(coded[1].dictionary) + codes[1]))
        firsts = pa.array([at[0] for at in places], pa.int64())
        parts = [events.take(pa.array(at)) for at in places]
        latest = [pc.max(part.column("ts").fill_null(0)) for part in parts]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(firsts) for c in KEY], pa.array(latest, pa.int64()), pa.array(map(packed, parts), pa.binary())],
            names=[*KEY, "ts", "packed"],
        )


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answered events of packed rows, one a row."""

    def parts():
        for batch in batches:
            for *key, value in zip(*[batch.column(c) for c in (*KEY, "packed")]):
                events = unpacked(value.as_py(), ANSWERED)
                columns = [pa.repeat(k, events.num_rows) for k in key] + events.columns
                yield pa.RecordBatch.from_arrays(columns, names=[*KEY, *ANSWERED.names])

    yield from gathered(parts(), 10_000)


class ClaimProcessor(StatefulProcessor):
    """One claim per (repo, signature), changed in event-time order whatever the order of arrival.

    An event waits in the state until the watermark has passed it, as nothing but late
    events can come before it then. Events wait by spans of time, in chunks; a span of
    more than ``HELD`` events is cut into narrower ones before it is read, so that neither
    a micro-batch nor a key is ever held in one piece. A call to the state costs far more
    than an event, so a key has one timer: at its first event still waiting, or when its
    claim can no longer matter. It answers all events that the watermark has passed, a
    span at a time, as the batch operator answers a batch.

    Takes and gives one event a row; ``PackedClaimProcessor`` many.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", STATE)
        self.timer = handle.getValueState("timer", "at long")
        self.spans = handle.getMapState("spans", "start long, width long", "chunks long, size long, first long")
        self.waiting = handle.getMapState("waiting", "start long, width long, chunk long", "packed binary")

    def read(self, rows: Iterator[Row]) -> Iterator[pa.RecordBatch]:
        while some := [row.asDict() for row in islice(rows, HELD)]:
            yield pa.RecordBatch.from_pylist(some, schema=EVENTS)

    def told(self, key, events: pa.RecordBatch, answers: list[pa.Array]) -> Iterator[Row]:
        for row in answered(events, answers).to_pylist():
            yield Row(repo=key[0], signature_hash=key[1], **row)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark, taken, count, first = timerValues.getCurrentWatermarkInMs(), {}, 0, None
        for batch in self.read(rows):
            late = pc.less(batch.column("ts"), watermark).fill_null(True)
            if pc.any(late).as_py():
                yield from self.told(key, events := batch.filter(late), late_answers(events.num_rows))
                batch = batch.filter(pc.invert(late))
            if not batch.num_rows:
                continue
            earliest = pc.min(batch.column("ts")).as_py()
            first = earliest if first is None else min(first, earliest)
            for span, events in by_span(batch, WIDTHS[0]):
                taken.setdefault(span, []).append(events)
            count += batch.num_rows
            if count >= HELD:
                self.wait(taken)
                taken, count = {}, 0
        self.wait(taken)
        if first is not None:
            self.wake(first + 1)  # events of this very time may still come

    def wake(self, at: int) -> None:
        """A timer at a time, unless an earlier one is set: that one sets the next."""
        if not self.timer.exists() or self.timer.get()[0] > at:
            self.timer.update((at,))
            self.handle.registerTimer(at)

    def wait(self, taken) -> None:
        for span, parts in taken.items():
            events = pa.concat_batches(parts)
            first = pc.min(events.column("ts")).as_py()
            chunks, size, earlier = self.spans.getValue(span) if self.spans.containsKey(span) else (0, 0, first)
            self.waiting.updateValue((*span, chunks), (packed(events),))
            self.spans.updateValue(span, (chunks + 1, size + events.num_rows, min(first, earlier)))

    def chunks_of(self, span) -> Iterator[pa.RecordBatch]:
        """The chunks of a span; they no longer wait."""
        chunks = self.spans.getValue(span)[0]
        self.spans.removeKey(span)
        for chunk in range(chunks):
            events = unpacked(self.waiting.getValue((*span, chunk))[0], EVENTS)
            self.waiting.removeKey((*span, chunk))
            yield events

    def narrowed(self, span) -> list:
        """The spans that the events of a wide one now wait in."""
        width, found = WIDTHS[WIDTHS.index(span[1]) + 1], set()
        for events in gathered(self.chunks_of(span), HELD):
            taken = {narrow: [part] for narrow, part in by_span(events, width)}
            self.wait(taken)
            found.update(taken)
        return sorted(found)

    def due(self, watermark: int) -> Iterator[pa.RecordBatch]:
        """The events before the watermark in their order, span by span; they no longer wait."""
        spans = {tuple(span): tuple(value) for span, value in self.spans.iterator()}
        places = [(start, -width) for start, width in spans]
        heapify(places)
        while places and places[0][0] < watermark:
            start, minus = heappop(places)
            span = (start, -minus)
            _, size, first = spans.pop(span)
            if first >= watermark:
                continue
            holds_others = bool(places) and places[0][0] < start - minus
            if span[1] > 1 and (holds_others or size > HELD):
                for narrow in self.narrowed(span):
                    if narrow not in spans:
                        heappush(places, (narrow[0], -narrow[1]))
                    spans[narrow] = tuple(self.spans.getValue(narrow))
                continue
            events = pa.concat_batches(list(self.chunks_of(span)))
            passed = pc.less(events.column("ts"), watermark)
            if not pc.all(passed).as_py():
                self.wait({span: [events.filter(pc.invert(passed))]})
                events = events.filter(passed)
            yield events.take(pc.sort_indices(events, sort_keys=ORDER, null_placement="at_start"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        if not self.timer.exists() or self.timer.get()[0] != expiredTimerInfo.getExpiryTimeInMs():
            return  # a later timer, which an earlier one has replaced
        self.timer.clear()
        state = tuple(self.claim.get()) if self.claim.exists() else None
        before = state
        for events in self.due(watermark):
            answers, state = verdicts_of(Batch(keyed(key, events), tuple(key)), state)
            yield from self.told(key, events, answers)
        if state is not None and watermark >= self.end(state):
            state = None
        if state is None:
            if before is not None:
                self.claim.clear()
        elif state != before:
            self.claim.update(state)
        after = [value[2] + 1 for _, value in self.spans.iterator()] + self.ends(state)
        if after:
            self.wake(min(after))

    def ends(self, state) -> list[int]:
        """Times at which a claim has to be looked at again, were there no event."""
        return [] if state is None else [self.end(state)]

    @staticmethod
    def end(state) -> int:
        _, claimed, completed = state
        return claimed + S.STALE_CLAIM_MS if completed is None else completed + S.CLAIM_RETENTION_MS + 1

    def close(self) -> None:
        pass


def by_span(events: pa.RecordBatch, width: int) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    ts = events.column("ts").to_numpy()
    starts = ts - ts % width
    for at in groups(starts):
        yield (int(starts[at[0]]), width), events.take(pa.array(at))


def keyed(key, events: pa.RecordBatch) -> pa.RecordBatch:
    """Events with the columns of their key, as the batch operator reads them."""
    columns = [pa.repeat(pa.scalar(k, pa.string()), events.num_rows) for k in key]
    return pa.RecordBatch.from_arrays([*columns, *events.columns], names=[*KEY, *EVENTS.names])


def answered(events: pa.RecordBatch, answers: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*events.columns, *answers], schema=ANSWERED)


def late_answers(rows: int) -> list[pa.Array]:
    values = ("late", None, None, None)
    return [pa.repeat(pa.scalar(value, kind), rows) for value, (_, kind) in zip(values, ANSWER)]


class PackedClaimProcessor(ClaimProcessor):
    """Takes rows of ``pack`` and gives rows for ``unpack``."""

    def read(self, rows: Iterator[Row]) -> Iterator[pa.RecordBatch]:
        return (unpacked(row.packed, EVENTS) for row in rows)

    def told(self, key, events: pa.RecordBatch, answers: list[pa.Array]) -> Iterator[Row]:
        yield Row(repo=key[0], signature_hash=key[1], packed=packed(answered(events, answers)))


class InFlightProcessor(PackedClaimProcessor):
    """The number of running claims of a signature, as the changes of it: one up or down.

    A claim runs until it is released, forgotten or taken over, and until it is more
    than ten minutes old, which a timer of its own tells.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.running = handle.getValueState("running", "claimed_at long")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self.running.get()[0] if self.running.exists() else None
        self.now, self.watermark = before, timerValues.getCurrentWatermarkInMs()
        for _ in super().handleExpiredTimer(key, timerValues, expiredTimerInfo):
            pass
        if self.now != before:
            if self.now is None:
                self.running.clear()
            else:
                self.running.update((self.now,))
        change = (self.now is not None) - (before is not None)
        if change:
            yield Row(repo=key[0], signature_hash=key[1], change=change)

    def ends(self, state) -> list[int]:
        # a claim that has run out by the watermark no longer counts, whatever its timer
        if self.now is not None and self.now + S.STALE_CLAIM_MS < self.watermark:
            self.now = None
        running = [] if self.now is None else [self.now + S.STALE_CLAIM_MS + 1]
        return super().ends(state) + running

    def told(self, key, events: pa.RecordBatch, answers: list[pa.Array]) -> Iterator[Row]:
        changed = np.flatnonzero(pc.is_in(answers[0], pa.array(["new", "released", "forgotten"])))
        if len(changed):
            last = int(changed[-1])
            self.now = events.column("ts")[last].as_py() if answers[0][last].as_py() == "new" else None
        return iter([])


def packed_by_key(events: DataFrame, lateness_ms: int):
    """The events packed by tasks, with their watermark, grouped by key."""
    rows = events.select(*EVENT).mapInArrow(pack, PACKED)
    return watermarked(rows, "ts", lateness_ms).groupBy(*KEY)


def in_flight_changes(events: DataFrame, lateness_ms: int = S.MINUTE_MS) -> DataFrame:
    """repo, signature_hash, change: +1 or -1 whenever a claim begins or ends to be in flight.

    In event time, behind the watermark like the verdicts. Late events change nothing.
    """
    return packed_by_key(events, lateness_ms).transformWithState(
        statefulProcessor=InFlightProcessor(),
        outputStructType="repo string, signature_hash string, change long",
        outputMode="Append",
        timeMode="EventTime",
    )


def claim_verdicts(events: DataFrame, lateness_ms: int = S.MINUTE_MS) -> DataFrame:
    """Streaming verdicts for claim, release and forget events.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    Events that are at most ``lateness_ms`` behind the newest one are applied in the
    order of (ts, event_id), in whatever micro-batches and order they arrive, and get the
    verdicts of the batch operator once the watermark has passed them. Events further
    behind, and events without a time, are answered ``late`` at once and leave the claim
    alone, however late they are.
    """
    told = packed_by_key(events, lateness_ms).transformWithState(
        statefulProcessor=PackedClaimProcessor(),
        outputStructType="repo string, signature_hash string, packed binary",
        outputMode="Append",
        timeMode="EventTime",
    )
    return told.mapInArrow(unpack, VERDICT)
