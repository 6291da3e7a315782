"""Chat history on a stream: the newest messages of every repository."""

from collections.abc import Iterator
from heapq import heappush, heappushpop

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from faultline import schemas as S

MESSAGE = "id long, role string, content string, created_at long"
HISTORY = f"repo string, {MESSAGE}, version long"


class RingProcessor(StatefulProcessor):
    """The newest ``limit`` messages of a repository; what falls out of them is trimmed at once.

    Messages are ordered by id, whatever the order they come in. State and memory hold
    ``limit`` messages of a repository, not a micro-batch of them. A micro-batch that
    changes the history gives it out as its next version.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", MESSAGE)
        self.version = handle.getValueState("version", "version long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept, changed = [], False
        for message in self.ring.get() if self.ring.exists() else ():
            heappush(kept, self.placed(tuple(message)))
        for row in rows:
            new = self.placed((row.id, row.role, row.content, row.created_at))
            if len(kept) < self.limit:
                heappush(kept, new)
                changed = True
            else:
                changed |= heappushpop(kept, new) != new
        if not changed:
            return
        messages = [message for _, message in sorted(kept, key=lambda k: k[0])]
        self.ring.put(messages)
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        for message in messages:
            names = ("id", "role", "content", "created_at")
            yield Row(repo=key[0], **dict(zip(names, message)), version=version)

    @staticmethod
    def placed(message):
        """A message behind what orders it: null ids are the oldest, equal ids go by their other values."""
        id_, role, content, created_at = message
        return [(x is not None, x) for x in (id_, created_at, role, content)], message

    def close(self) -> None:
        pass


def trim_history(messages: DataFrame, limit: int = S.HISTORY_MESSAGES) -> DataFrame:
    """The newest messages of every repository, given out anew with each micro-batch that changes them.

    A reader takes the highest ``version`` of a repository (``latest``). Needs the
    RocksDB state store.
    """
    cut = messages.withColumn("content", F.substring("content", 1, S.MESSAGE_CHARS))
    return cut.groupBy("repo").transformWithState(
        statefulProcessor=RingProcessor(limit),
        outputStructType=HISTORY,
        outputMode="Append",
        timeMode="None",
    )


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of every history; the number of versions, not of messages, is what it costs."""
    newest = versions.groupBy("repo").agg(F.max("version").alias("newest"))
    same = versions["repo"].eqNullSafe(newest["repo"]) & (F.col("version") == F.col("newest"))
    return versions.join(newest, same, "left_semi").drop("version")
