"""Watermarks that drop no row.

Spark drops a row whose time is behind the watermark before a stateful operator sees
it. Here the time column is moved ``SHIFT_MS`` ahead and the delay of the watermark
is as much longer, so the watermark has the same value, timers fire at the same
times, and no row is behind it; the operator decides what a late row means.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHIFT_MS = 1_000_000 * 86_400_000  # more than any two times of a table are apart


def watermarked(rows: DataFrame, ms: str, delay_ms: int, column: str = "at") -> DataFrame:
    """Adds ``column``; the watermark is the largest ``ms`` so far less ``delay_ms``."""
    moved = F.timestamp_millis(F.coalesce(F.col(ms), F.lit(0)) + F.lit(SHIFT_MS))
    return rows.withColumn(column, moved).withWatermark(column, f"{SHIFT_MS + delay_ms} milliseconds")
