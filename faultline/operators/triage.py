"""Triage outcomes: approval window, result edits, new rows, audit steps, outbox."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.functions.ordering import with_row_numbers
from faultline.functions.text import filled, fixed
from faultline.sources.checkpoints import checkpointed

# fixed value
EXPIRED_NOTE = (
    "\n\n_Auto-posted: the 1 hour approval window expired without a reviewer decision._"
)


def first_decisions(pending: DataFrame, approvals: DataFrame) -> DataFrame:
    """First approval of each pending failure within its window: (failure_id, decision).

    One row per failure on the pending side, and the decision is an aggregate that
    merges before the shuffle, so a failure with very many events is cut up by the
    adaptive skew join and reduced where it lies.
    """
    windows = pending.select("failure_id", "pending_at")
    close = F.col("pending_at") + S.APPROVAL_WINDOW_MS
    hits = approvals.join(windows, "failure_id").filter(F.col("ts").between(F.col("pending_at"), close))
    decision = F.struct("approved", "edited_fix", "reviewer", "ts")
    return hits.groupBy("failure_id").agg(
        F.min_by(decision, F.struct("ts", "event_id")).alias("decision")
    )


def triage_outcomes(pending: DataFrame, approvals: DataFrame) -> DataFrame:
    """Outcome of every pending triage.

    ``pending`` holds failure_id, pending_at, verdict (the claim verdict),
    require_approval. Duplicates are skipped, unanswered reviews post anyway.
    """
    waiting = pending.filter((F.col("verdict") == "new") & F.col("require_approval"))
    joined = pending.join(first_decisions(waiting, approvals), "failure_id", "left")
    fresh = F.col("verdict") == "new"
    needs = F.col("require_approval")
    approved = F.col("decision.approved")
    approval = (
        F.when(~fresh | ~needs, "not_required")
        .when(approved, "approved")
        .when(F.col("decision").isNotNull(), "rejected")
        .otherwise("timed_out")
    )
    reason = (
        F.when(F.col("verdict") == "in_flight", "duplicate_in_flight")
        .when(~fresh, F.col("verdict"))
        .when(F.col("approval") == "rejected", "rejected")
        .otherwise("completed")
    )
    status = (
        F.when(~fresh, "skipped").when(F.col("approval") == "rejected", "dismissed").otherwise("triaged")
    )
    parked = F.when(~fresh, None).when(needs, "awaiting_approval").otherwise("triaged")
    return (
        joined.withColumn("approval", approval)
        .withColumn("reason", reason)
        .withColumn("status", status)
        .withColumn("persisted_status", parked)
        .withColumn("reviewer", F.col("decision.reviewer"))
        .withColumn("edited_fix", F.col("decision.edited_fix"))
        .drop("decision")
    )


def apply_approvals(results: DataFrame) -> DataFrame:
    """Final fix text from (suggested_fix, approval, edited_fix)."""
    fix = (
        F.when(F.col("approval") == "approved", F.coalesce(filled("edited_fix"), F.col("suggested_fix")))
        .when(F.col("approval") == "timed_out", F.concat("suggested_fix", F.lit(EXPIRED_NOTE)))
        .otherwise(F.col("suggested_fix"))
    )
    return results.withColumn("suggested_fix", fix)


def assemble_failures(incoming: DataFrame, dims: int = S.EMBEDDING_DIMS) -> DataFrame:
    """New failure rows from normalised deliveries joined with their signature columns.

    ``incoming`` carries the delivery fields and the fingerprint columns of the
    same row, so assembling is a projection.
    """
    null = F.lit(None)
    values = {
        "id": F.col("delivery_id"),
        "signature_hash": F.col("hash"),
        "signature_text": F.col("text"),
        "embedding": F.array_repeat(F.lit(0.0).cast("float"), dims),
        "signature_confidence": F.col("confidence"),
        "status": F.lit("open"),
        "is_likely_flake": F.lit(False),
        "cited_failure_ids": F.array(),
        "occurrence_count": F.lit(1),
        "created_at": F.col("occurred_at"),
        "last_seen_at": F.col("occurred_at"),
    }
    for name in ("root_cause", "suggested_fix", "confidence", "headline", "resolution_note", "resolved_at"):
        values[name] = null
    return incoming.select(
        *[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in S.FAILURES]
    )


def step_attempts(runs: DataFrame) -> DataFrame:
    """Per failure and step: attempts, results, time spent and the last state.

    A terminal row carries its own duration, so a step is summarised by plain
    aggregates that merge before the shuffle.
    """
    status = F.col("status")
    order = F.struct("created_at", "id")
    return runs.groupBy("failure_id", "step").agg(
        F.count_if(status == "started").alias("attempts"),
        F.count_if(status == "ok").alias("succeeded"),
        F.count_if(status == "error").alias("failed"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("busy_ms"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
        F.max_by("status", order).alias("last_status"),
    )


PAIR_BLOCK = 4096  # rows scanned by one window
STEP = ["failure_id", "step"]


def step_pairs(runs: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """Every attempt of a step as a row: what started it, what ended it, and how it stands.

    Rows of a (failure, step) follow each other by (created_at, id). A ``started`` row is
    closed by the row behind it if that is a terminal one; then ``state`` is its status.
    A start that another start follows is ``abandoned``, the last one is ``open``. A
    terminal row that closes nothing is ``unstarted``. ``attempt`` counts the starts, so
    a retry is an attempt above one; it is null for unstarted rows. Null ids and steps
    are keys of their own.

    The rows are numbered over all keys and scanned in blocks, so a failure with very
    many rows is many blocks: what crosses a border is one row per block.
    """
    kept = runs.select(*STEP, "id", "status", "created_at", "duration_ms")
    numbered = with_row_numbers(kept, [*STEP, "created_at", "id"], "n")
    place = numbered.withColumn("block", F.expr(f"(n - 1) div {block}"))
    begins = (F.col("status") == "started").cast("long")
    within = Window.partitionBy("block").orderBy("n")
    so_far = Window.partitionBy("block", *STEP).orderBy("n")
    row = F.struct(*STEP, "id", "status", "created_at", "duration_ms")
    scanned = place.select(
        "block", "n", row.alias("own"), F.lead(row).over(within).alias("next"),
        F.sum(begins).over(so_far).alias("starts"),
    )
    # one row per block: its first row, its last row and the starts of its last key
    ends = checkpointed(
        scanned.groupBy("block").agg(
            F.min_by("own", "n").alias("first"), F.max_by(F.struct("own", "starts"), "n").alias("last")
        )
    )
    key = [F.col(f"last.own.{c}") for c in STEP]
    earlier = F.sum("last.starts").over(Window.partitionBy(*key).orderBy("block"))
    before = ends.select((F.col("block") + 1).alias("block"), F.col("last.own").alias("previous"), earlier.alias("carried"))
    after = ends.select((F.col("block") - 1).alias("block"), F.col("first").alias("following"))
    borders = ends.select("block", "first").join(before, "block", "left").join(after, "block", "left").select(
        "block", "following", F.when(same_step("first", "previous"), F.col("carried")).alias("carried"),
        F.struct(*[F.col(f"first.{c}") for c in STEP]).alias("head"),
    )
    joined = scanned.join(borders, "block")
    more = F.when(same_step("own", "head"), F.coalesce("carried", F.lit(0))).otherwise(0)
    paired = joined.select(
        "n", "own", F.coalesce("next", "following").alias("next"), (F.col("starts") + more).alias("attempt")
    )
    own, following = F.col("own"), F.col("next")
    started, ended = own["status"] == "started", following["status"] != "started"
    closes = started & same_step("own", "next") & ended
    state = (
        F.when(closes, following["status"]).when(same_step("own", "next"), "abandoned").otherwise("open")
    )
    opened = F.when(started, attempt_row(own, F.when(closes, following), state, F.col("attempt")))
    orphan = F.when(ended & ~closes, attempt_row(None, following, F.lit("unstarted"), F.lit(None)))
    first = F.when((F.col("n") == 1) & ~started, attempt_row(None, own, F.lit("unstarted"), F.lit(None)))
    rows = F.filter(F.array(opened, orphan, first), lambda x: x.isNotNull())
    return paired.select(F.inline(rows))


def same_step(a: str, b: str) -> Column:
    """Whether two rows belong to one key; false where one of them is missing."""
    equal = F.lit(True)
    for name in STEP:
        equal = equal & F.col(f"{a}.{name}").eqNullSafe(F.col(f"{b}.{name}"))
    return F.col(a).isNotNull() & F.col(b).isNotNull() & equal


def attempt_row(start: Column | None, end: Column | None, state: Column, attempt: Column) -> Column:
    def of(row, name, kind):
        return (F.lit(None) if row is None else row[name]).cast(kind)

    key = end if start is None else start
    return F.struct(
        *[key[c].alias(c) for c in STEP], attempt.cast("long").alias("attempt"), state.alias("state"),
        of(start, "id", "string").alias("started_id"), of(end, "id", "string").alias("ended_id"),
        of(start, "created_at", "long").alias("started_at"), of(end, "created_at", "long").alias("ended_at"),
        of(end, "duration_ms", "long").alias("duration_ms"),
    )


def percent(share) -> Column:
    return fixed(F.floor(share * 100 + 0.5).cast("double"), 0)


def postback_outbox(results: DataFrame, has_credentials: bool, product: str = "Triage") -> DataFrame:
    """What would be posted for each result; nothing is sent.

    A result that lacks one of the posted parts is not ready: its reason is ``no_result``.
    """
    no_url = F.coalesce(F.col("run_url"), F.lit("")) == ""
    body = F.concat(
        F.lit("**"), F.col("headline"), F.lit("**\n\n**Root cause** — "), F.col("root_cause"),
        F.lit("\n\n**Suggested fix**\n"), F.col("suggested_fix"),
        F.lit(f"\n\n_{product} · confidence "), percent(F.col("confidence")), F.lit("%_"),
    )
    if has_credentials:
        reason = F.when(no_url, "no_run_url").when(body.isNull(), "no_result").otherwise("ready")
        detail = F.lit(None).cast("string")
        text = F.when(~no_url, body)
    else:
        reason = F.when(no_url, "no_run_url").otherwise("no_credentials")
        detail = F.when(~no_url, F.concat(F.lit("would POST triage to "), F.col("run_url")))
        text = F.lit(None).cast("string")
    return results.select(
        "id", "run_url", reason.alias("reason"), detail.alias("detail"), text.alias("body")
    )
