"""Continuous ingest: deliveries to fingerprinted failures, written once per delivery."""

from collections.abc import Callable, Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from faultline.operators import failures as ops
from faultline.operators import fingerprint, ingest, triage
from faultline.sources import tables
from faultline.streaming.late import watermarked

PASSED = ["delivery_id", "received_at", "require_approval", *ingest.INCOMING]


def accepted(deliveries: DataFrame) -> DataFrame:
    """Accepted failures with their signature. Only row-wise steps: no state, no shuffle."""
    rows = ingest.normalise_deliveries(deliveries).filter("outcome = 'accepted'")
    keep = [c for c in PASSED if c != "log_text"]
    return fingerprint.fingerprint_logs(rows, "log_text", keep=keep)


def refused(deliveries: DataFrame) -> DataFrame:
    """Ignored and rejected deliveries with the reason, for the side table."""
    return (
        ingest.normalise_deliveries(deliveries)
        .filter("outcome <> 'accepted'")
        .select("delivery_id", "received_at", "outcome", "reason")
    )


BUCKETS = 512  # groups of delivery ids
SHARES = 64  # parts of the state of a group


class OnceProcessor(StatefulProcessor):
    """The first row of an id; a timer forgets the ids whose repeats are no longer expected.

    A group and a call to the state cost far more than a row, so ids are grouped by their
    hash. A micro-batch reads the shares of the group its ids lie in once, and writes those
    that have new ids.
    """

    def __init__(self, lateness_ms: int, columns: list[str]):
        self.lateness_ms, self.columns = lateness_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")
        self.seen = handle.getMapState("seen", "share int", "ids array<string>, until array<bigint>")

    def share_of(self, delivery_id: str | None) -> tuple[int]:
        return (crc32((delivery_id or "").encode()) % SHARES,)

    def held(self, share: tuple[int]) -> dict:
        """When each id of a share is forgotten."""
        return dict(zip(*self.seen.getValue(share), strict=True)) if self.seen.containsKey(share) else {}

    def hold(self, shares: dict) -> None:
        for share, ids in shares.items():
            self.seen.updateValue(share, (list(ids), list(ids.values())))

    def wake(self, at: int) -> None:
        """A timer at a time, unless an earlier one is set: that one sets the next."""
        if not self.timer.exists() or self.timer.get()[0] > at:
            self.timer.update((at,))
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark, read, changed, first = timerValues.getCurrentWatermarkInMs(), {}, set(), None
        for row in rows:
            share = self.share_of(row.delivery_id)
            if share not in read:
                read[share] = self.held(share)
            if row.delivery_id not in read[share]:
                until = max(row.received_at or 0, watermark) + self.lateness_ms
                first = until if first is None else min(first, until)
                read[share][row.delivery_id] = until
                changed.add(share)
                yield Row(**{c: row[c] for c in self.columns})
        self.hold({share: read[share] for share in changed})
        if first is not None:
            self.wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not self.timer.exists() or self.timer.get()[0] != at:
            return iter([])  # a later timer, which an earlier one has replaced
        self.timer.clear()
        passed, first = max(timerValues.getCurrentWatermarkInMs(), at + 1), []
        for share in list(self.seen.keys()):
            ids = self.held(share)
            left = {i: until for i, until in ids.items() if until >= passed}
            if not left:
                self.seen.removeKey(share)
                continue
            if len(left) < len(ids):
                self.hold({share: left})
            first.append(min(left.values()))
        if first:
            self.wake(min(first))
        return iter([])

    def close(self) -> None:
        pass


def once(deliveries: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Drop repeats of a delivery id that arrive within the lateness bound.

    A delivery is never dropped for being late; one whose repeat comes after the bound
    comes out twice and refreshes its failure. Needs the RocksDB state store.
    """
    lateness_ms = int(pd.Timedelta(lateness).total_seconds() * 1000)
    timed = watermarked(deliveries, "received_at", lateness_ms, "received")
    bucket = F.pmod(F.xxhash64("delivery_id"), F.lit(BUCKETS))
    return timed.withColumn("_bucket", bucket).groupBy("_bucket").transformWithState(
        statefulProcessor=OnceProcessor(lateness_ms, deliveries.columns),
        outputStructType=deliveries.schema,
        outputMode="Append",
        timeMode="EventTime",
    )


class ChangeWriter:
    """foreachBatch sink: the new failure rows of each micro-batch, in a folder of their own.

    The cost of a batch depends on the batch, not on the table. A retried batch
    overwrites its own folder. ``tables.current_failures`` shows the table with the
    changes applied and ``tables.compact`` folds them into the next snapshot.
    """

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        tables.write_changes(triage.assemble_failures(batch), self.path, batch_id)


class ResolutionWriter:
    """foreachBatch sink: resolutions (id, note, at, workflow_id) and their audit rows as one unit.

    The folder of resolutions that ``tables.current_failures`` applies is written
    last, so a resolution is never visible without its audit rows. A retried batch
    rewrites both folders. ``failures`` gives the failures that can have the ids of a
    batch, such as ``parted.read_named`` does, so that the rest of the table is not read.
    """

    def __init__(self, path: str, runs: str, failures: Callable[[DataFrame], DataFrame]):
        self.path, self.runs, self.failures = path, runs, failures

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # both writes take the same rows
        try:
            audit = ops.audit_rows(ops.resolve_audit(held, self.failures(held)))
            audit.write.mode("overwrite").parquet(f"{self.runs}/batch={batch_id}")
            held.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        finally:
            held.unpersist()
