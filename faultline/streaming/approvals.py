"""Approval gate on a stream: wait for a decision within the window, then auto-post."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import schemas as S


def gate(pending: DataFrame, approvals: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Left-outer interval join on the failure id.

    A pending row without a decision comes out once the watermark has passed its
    window, as ``timed_out``. Several decisions of one failure all come out, with
    ``decided_at``; the sink keeps the first (see ``first_per_failure``).
    """
    p = pending.select(
        "failure_id", F.timestamp_millis("pending_at").alias("pending_ts")
    ).withWatermark("pending_ts", lateness)
    a = approvals.select(
        F.col("failure_id").alias("decided_id"), "approved", "edited_fix", "reviewer",
        F.col("event_id").alias("decision_id"), F.timestamp_millis("ts").alias("decided_at"),
    ).withWatermark("decided_at", lateness)
    window = F.expr(f"INTERVAL {S.APPROVAL_WINDOW_MS // 1000} SECONDS")
    within = (
        (F.col("failure_id") == F.col("decided_id"))
        & (F.col("decided_at") >= F.col("pending_ts"))
        & (F.col("decided_at") <= F.col("pending_ts") + window)
    )
    approval = (
        F.when(F.col("approved"), "approved")
        .when(F.col("decided_id").isNotNull(), "rejected")
        .otherwise("timed_out")
    )
    return p.join(a, within, "left_outer").withColumn("approval", approval).drop("decided_id")


def first_per_failure(decisions: DataFrame) -> DataFrame:
    """First decision of each failure in a gate's output table."""
    row = F.struct("approval", "edited_fix", "reviewer", "decided_at")
    return (
        decisions.groupBy("failure_id")
        .agg(F.min_by(row, F.struct("decided_at", "decision_id")).alias("d"))
        .select("failure_id", "d.*")
    )
