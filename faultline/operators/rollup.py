"""Reports over N days from day partials, exact to the millisecond.

A partial holds what one signature did on one day: occurrences, the latest time, and
how many of its failures are open and resolved. Partials of a day add up, so rows that
come late are just further partials of their day. A window that ends now begins in the
middle of a day: whole closed days inside it are read from the partials, the day it
begins in and the days not closed yet are read from the failures, which is two short
ranges of their time column. Closed days cost one row per signature, however many
failures they had.

Rows without a time are in no window, and partials without a day neither.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.operators import stats

DAY_KEY = ["repo", "signature_hash", "signature_text", "day_ms"]


def day_of(ms: Column) -> Column:
    return (F.floor(ms / S.DAY_MS) * S.DAY_MS).cast("long")


def day_partials(failures: DataFrame) -> DataFrame:
    """Per repo, signature, text and day: occurrence_count, last_seen_at, open_count, resolved_count."""
    dated = failures.withColumn("day_ms", day_of(F.col("last_seen_at")))
    return dated.groupBy(*DAY_KEY).agg(
        F.sum("occurrence_count").alias("occurrence_count"),
        F.max("last_seen_at").alias("last_seen_at"), *stats.status_counts(),
    )


def window_partials(
    partials: DataFrame, failures: DataFrame, now_ms: int, days: int, closed_ms: int
) -> DataFrame:
    """The partials that make up a window.

    ``closed_ms`` is the start of the first day that is not closed: every failure seen
    before it, late ones too, is in ``partials``.
    """
    since = now_ms - max(1, min(days, 365)) * S.DAY_MS
    whole = -(-since // S.DAY_MS) * S.DAY_MS  # the first day that lies in the window as a whole
    edge = max(whole, closed_ms // S.DAY_MS * S.DAY_MS)
    seen = F.col("last_seen_at")
    edges = failures.filter((seen >= since) & ((seen < whole) | (seen >= edge)))
    inside = partials.filter((F.col("day_ms") >= whole) & (F.col("day_ms") < edge))
    part = day_partials(edges)
    return inside.select(part.columns).unionByName(part)


def top_flakes(
    partials: DataFrame, failures: DataFrame, now_ms: int, closed_ms: int, days: int = 7,
    limit: int = S.TOP_FLAKES,
) -> DataFrame:
    """The rows of ``stats.top_flakes``, from partials and the edges of the window."""
    window = window_partials(partials, failures, now_ms, days, closed_ms)
    return stats.ranked_flakes(
        window.select(
            "repo", "signature_hash", "signature_text", F.col("occurrence_count").alias("count"),
            F.col("last_seen_at").alias("seen"),
        ),
        limit,
    )


def repo_counts(
    partials: DataFrame, failures: DataFrame, now_ms: int, closed_ms: int, days: int = 7
) -> DataFrame:
    """The rows of ``stats.repo_counts``, from partials and the edges of the window."""
    return window_partials(partials, failures, now_ms, days, closed_ms).groupBy("repo").agg(
        F.sum("open_count").alias("open_count"), F.sum("resolved_count").alias("resolved_count")
    )
