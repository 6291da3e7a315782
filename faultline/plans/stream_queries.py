"""Queries that replay the derived tables through the stream operators.

The checking SQL is that of the batch operator, since a stream has to give its rows
whatever the cut. The rows arrive in three slices, out of order within the lateness.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import schemas as S
from faultline.operators import rollup
from faultline.operators.ingest import normalise_deliveries
from faultline.plans import catalog, queries as batch, views
from faultline.plans.catalog import query
from faultline.plans.replay import replayed
from faultline.streaming import approvals, claims, counters, history, ingest

SLICES = 3
LATENESS = 20 * S.MINUTE_MS
START = 1_704_067_200_000  # the first time in the test tables
FAR = views.NOW_MS + 100 * S.DAY_MS
LATE = "event_id % 97 = 0"


def in_slices(rows: DataFrame, ms: str, span_ms: int) -> Column:
    """Slices by time, some rows one slice later, as far as the lateness allows."""
    jitter = F.pmod(F.xxhash64(*rows.columns), F.lit(LATENESS - S.MINUTE_MS))
    return F.least(F.floor((F.col(ms) + jitter - START) / F.lit(span_ms / SLICES)), F.lit(SLICES - 1))


def with_end(rows: DataFrame, ms: str, at: int, slices: Column) -> tuple[DataFrame, Column]:
    """The rows with a last one that moves the watermark to ``at`` less the lateness; its texts are ``end``."""
    values = {f.name: "end" if f.dataType == T.StringType() else None for f in rows.schema} | {ms: at}
    end = rows.sparkSession.range(1).select(*[F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in rows.schema])
    held = rows.withColumn("_at", slices).unionByName(end.withColumn("_at", F.lit(SLICES)))
    return held, F.col("_at")


def replay_of(rows: DataFrame, ms: str, at: int, slices: Column, through, key=None) -> DataFrame:
    held, slice_ = with_end(rows, ms, at, slices)
    columns = rows.columns
    return replayed([(held, slice_)], SLICES + 1, lambda s: through(s.select(*columns)), key)


# the rows of LATE come when the stream is two days ahead
catalog.SHARED["sh_timely_rows"] = f"""
SELECT *, row_number() OVER (PARTITION BY repo, signature_hash ORDER BY ts, event_id) AS rn FROM fx_claims WHERE NOT ({LATE})
"""


@query("stream_claims", batch.CLAIM_SQL.replace("sh_claim_rows", "sh_timely_rows") + batch._verdicts + f"""
UNION ALL SELECT repo, signature_hash, failure_id, ts, kind, event_id, 'late', NULL, NULL, NULL FROM fx_claims WHERE {LATE}
""")
def _(t):
    rows = t.claims
    late = F.expr(LATE)
    timely = in_slices(rows, "ts", 3 * S.DAY_MS)
    held, slice_ = with_end(rows, "ts", FAR, F.when(late, SLICES + 1).otherwise(timely))
    columns = rows.columns
    out = replayed([(held, slice_)], SLICES + 2, lambda s: claims.claim_verdicts(s.select(*columns), LATENESS))
    return out.filter("repo <> 'end'")


IN_FLIGHT_AT = START + 2 * S.DAY_MS + 7 * S.HOUR_MS + 11 * S.MINUTE_MS
catalog.SHARED["sh_earlier_rows"] = f"""
SELECT *, row_number() OVER (PARTITION BY repo, signature_hash ORDER BY ts, event_id) AS rn FROM fx_claims WHERE ts < {IN_FLIGHT_AT}
"""


@query("stream_in_flight", batch.CLAIM_SQL.replace("sh_claim_rows", "sh_earlier_rows") + f"""
SELECT repo, cast(count(*) FILTER (completed_at IS NULL AND claimed_at >= {IN_FLIGHT_AT - S.STALE_CLAIM_MS}) AS BIGINT) AS in_flight
FROM ({batch._current}) GROUP BY repo
""")
def _(t):
    rows = t.claims.filter(F.col("ts") < IN_FLIGHT_AT)
    running = replay_of(
        rows, "ts", IN_FLIGHT_AT + LATENESS, in_slices(rows, "ts", 3 * S.DAY_MS),
        lambda s: counters.live_in_flight(s, LATENESS), ["repo"],
    )
    # a repository of which no claim was ever seen running has no row
    repos = rows.select("repo").distinct()
    return repos.join(running, "repo", "left").select("repo", F.coalesce("in_flight", F.lit(0)).alias("in_flight"))


@query("stream_counters", """
SELECT repo, count(*) AS total_failures, count(*) FILTER (status = 'resolved') AS total_resolved, max(last_seen_at) AS last_failure_at
FROM fx_failures GROUP BY repo
""")
def _(t):
    rows = t.failures.select("repo", "status", "last_seen_at")
    slices = F.pmod(F.xxhash64(*rows.columns), F.lit(SLICES))
    return replayed([(rows, slices)], SLICES, counters.live_counters, ["repo"])


def days_of(t) -> DataFrame:
    """Day partials through the stream; a tenth of the rows come when their days are closed."""
    rows = t.failures.select("repo", "signature_hash", "signature_text", "status", "occurrence_count", "last_seen_at")
    late = F.pmod(F.xxhash64(*rows.columns), F.lit(10)) == 0
    slices = F.when(late, SLICES + 1).otherwise(in_slices(rows, "last_seen_at", 30 * S.DAY_MS))
    held, slice_ = with_end(rows, "last_seen_at", FAR, slices)
    days = replayed([(held, slice_)], SLICES + 2, counters.daily_signatures)
    return counters.partials_of(days).filter("repo <> 'end'")


@query("stream_top_flakes", batch._flakes.replace(str(batch.NOW - 7 * S.DAY_MS), str(batch.EDGE - 9 * S.DAY_MS)))
def _(t):
    return rollup.top_flakes(days_of(t), t.failures, batch.EDGE, batch.CLOSED, 9)


@query("stream_history", "SELECT repo, id, role, substring(content, 1, 8000) AS content, created_at FROM fx_messages "
       f"QUALIFY {batch._history} <= 50")
def _(t):
    slices = F.pmod(F.xxhash64("id"), F.lit(SLICES))
    return history.latest(replayed([(t.messages, slices)], SLICES, history.trim_history))


@query("stream_approvals", """
SELECT failure_id, approval, reviewer, edited_fix FROM sh_outcomes WHERE verdict = 'new' AND require_approval
""")
def _(t):
    waiting = batch.pending_of(t).filter("verdict = 'new' AND require_approval").select("failure_id", "pending_at")
    decided = t.approvals
    pending = with_end(waiting, "pending_at", FAR, in_slices(waiting, "pending_at", 30 * S.DAY_MS))
    events = with_end(decided, "ts", FAR, in_slices(decided, "ts", 30 * S.DAY_MS))
    lateness = f"{LATENESS // S.MINUTE_MS} minutes"
    out = replayed([pending, events], SLICES + 1, lambda p, a: approvals.gate(p, a, lateness))
    first = approvals.first_per_failure(out.filter("failure_id <> 'end'"))
    return first.select("failure_id", "approval", "reviewer", "edited_fix")


@query("stream_ingest")
def _(t):
    """Every delivery once, although a fifth of them are delivered again."""
    rows = t.deliveries
    again = rows.filter(F.pmod(F.xxhash64("delivery_id"), F.lit(5)) == 0).withColumn("_at", F.lit(1))
    first = rows.withColumn("_at", F.pmod(F.xxhash64("delivery_id", "received_at"), F.lit(2)).cast("int"))
    return replayed(
        [(first.unionByName(again), F.col("_at"))], 2,
        lambda s: normalise_deliveries(ingest.once(s.select(*rows.columns), "60 days")),
    )


catalog.ORACLES["stream_ingest"] = catalog.ORACLES["normalise_deliveries"]
