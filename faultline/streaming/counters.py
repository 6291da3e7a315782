"""Live counters and day-grain partial counts."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from faultline import schemas as S
from faultline.operators.rollup import DAY_KEY, day_of
from faultline.streaming.claims import in_flight_changes
from faultline.streaming.late import watermarked

PARTIAL = "occurrence_count long, last_seen_at long, open_count long, resolved_count long"


def live_counters(failures: DataFrame) -> DataFrame:
    """Running totals per repo (update mode); order of arrival does not matter."""
    return failures.groupBy("repo").agg(
        F.count("*").alias("total_failures"),
        F.count_if(F.col("status") == "resolved").alias("total_resolved"),
        F.max("last_seen_at").alias("last_failure_at"),
    )


def live_in_flight(events: DataFrame, lateness_ms: int = S.MINUTE_MS) -> DataFrame:
    """Running number of claims in flight per repo (update mode), as of the watermark.

    Two stateful operators in a row: the claims of a signature give changes by one, and
    these are summed per repo, so a repository with very many claims is merged before the
    shuffle. With ``live_counters`` these are the columns of ``stats.repo_counters``; a
    repository of which no claim was ever seen running has no row.
    Needs the RocksDB state store.
    """
    return in_flight_changes(events, lateness_ms).groupBy("repo").agg(F.sum("change").alias("in_flight"))


class DayProcessor(StatefulProcessor):
    """The sums of one signature and day, given out when the day is closed; later rows at once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", PARTIAL)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        closes = None if key[3] is None else key[3] + S.DAY_MS
        open_day = closes is not None and closes > timerValues.getCurrentWatermarkInMs()
        saved = tuple(self.sums.get()) if open_day and self.sums.exists() else (None, None, 0, 0)
        count, last, opened, resolved = saved
        for row in rows:
            if row.occurrence_count is not None:
                count = (count or 0) + row.occurrence_count
            if row.last_seen_at is not None:
                last = row.last_seen_at if last is None else max(last, row.last_seen_at)
            opened += row.status in S.OPEN_STATUSES
            resolved += row.status == "resolved"
        if not open_day:
            yield self.partial(key, (count, last, opened, resolved))
            return
        self.sums.update((count, last, opened, resolved))
        self.handle.registerTimer(closes)

    def partial(self, key, sums) -> Row:
        count, last, opened, resolved = sums
        return Row(
            repo=key[0], signature_hash=key[1], signature_text=key[2], day_ms=key[3],
            occurrence_count=count, last_seen_at=last, open_count=opened, resolved_count=resolved,
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.sums.exists():
            yield self.partial(key, tuple(self.sums.get()))
            self.sums.clear()

    def close(self) -> None:
        pass


def daily_signatures(failures: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Per repo, signature and day: occurrences and the latest time, once a day is closed.

    Rows of a closed day come out as further partials of it, one for each micro-batch:
    a reader adds the counts of a day up. Rows without a time have no day. Needs the
    RocksDB state store.
    """
    timed = watermarked(failures, "last_seen_at", int(pd.Timedelta(lateness).total_seconds() * 1000))
    days = timed.withColumn("day_ms", day_of(F.col("last_seen_at"))).groupBy(*DAY_KEY).transformWithState(
        statefulProcessor=DayProcessor(),
        outputStructType=f"repo string, signature_hash string, signature_text string, day_ms long, {PARTIAL}",
        outputMode="Append",
        timeMode="EventTime",
    )
    return days.withColumn("day", F.timestamp_millis("day_ms")).drop("day_ms")


def partials_of(days: DataFrame) -> DataFrame:
    """The written days as ``operators.rollup`` reads them, which adds the edges of a window."""
    return days.withColumn("day_ms", F.unix_millis("day")).drop("day")


def counts_from_days(days: DataFrame, since_day) -> DataFrame:
    """Whole-day window counts per repo from the daily partials."""
    return days.filter(F.col("day") >= since_day).groupBy("repo").agg(
        F.sum("open_count").alias("open_count"), F.sum("resolved_count").alias("resolved_count")
    )
