"""Reads and updates of the failures and audit tables.

Updates are joins on the failure id that return the new table; a writer puts the
result in place (see ``sources.tables``). Update tables are first reduced to one
row per id by an aggregate, so repeated ids neither multiply rows nor gather in
one task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.functions import variants as V
from faultline.functions.text import col, let, trim


def parse_cited(text) -> Column:
    """String elements of a JSON array in text; anything else is an empty list."""

    def strings(v):
        return F.transform(F.filter(V.elements(v), V.is_string), V.as_string)

    return F.coalesce(let(V.parse(col(text)), strings), F.array().cast("array<string>"))


def parse_cited_ids(df: DataFrame, text: str = "cited_text") -> DataFrame:
    return df.withColumn("cited_failure_ids", parse_cited(text)).drop(text)


def scan_failures(df: DataFrame) -> DataFrame:
    """Failure records without the vector, in schema order."""
    if "cited_failure_ids" not in df.columns:
        df = parse_cited_ids(df)
    types = {f.name: f.dataType for f in S.FAILURES}
    return df.select(*[df[c].cast(types[c]).alias(c) for c in S.FAILURE_COLUMNS])


def scan_runs(df: DataFrame) -> DataFrame:
    """Audit rows; a status outside the known three reads as an error."""
    return df.withColumn(
        "status", F.when(F.col("status").isin(S.RUN_STATUSES), F.col("status")).otherwise("error")
    )


# ---- reads -------------------------------------------------------------------
def get_failure(failures: DataFrame, failure_id: str) -> DataFrame:
    return failures.filter(F.col("id") == failure_id)


def recent_failures(failures: DataFrame, repo: str | None = None, limit: int = 25) -> DataFrame:
    rows = failures if repo is None else failures.filter(F.col("repo") == repo)
    return rows.orderBy(F.desc("last_seen_at"), "id").limit(max(1, min(limit, 200)))


def list_repos(failures: DataFrame, limit: int = 100) -> DataFrame:
    return (
        failures.groupBy("repo")
        .agg(F.max("last_seen_at").alias("seen"))
        .orderBy(F.desc("seen"), "repo")
        .limit(limit)
    )


def open_failures(failures: DataFrame) -> DataFrame:
    return failures.filter(~F.col("status").isin(S.CLOSED_STATUSES))


def find_open_by_signature(incoming: DataFrame, failures: DataFrame) -> DataFrame:
    """Attach the newest open failure with the same repo and signature, if any.

    The open side is one row per key after a partial aggregate. A key with very
    many incoming rows is split by the adaptive skew join.
    """
    newest = F.struct("last_seen_at", "id")
    latest = (
        open_failures(failures)
        .groupBy("repo", "signature_hash")
        .agg(F.max(newest).alias("open"))
        .select(
            "repo",
            "signature_hash",
            F.col("open.id").alias("open_failure_id"),
            F.col("open.last_seen_at").alias("open_last_seen_at"),
        )
    )
    return incoming.join(latest, ["repo", "signature_hash"], "left")


def audit_trail(runs: DataFrame, failure_id: str, limit: int = 100) -> DataFrame:
    return (
        scan_runs(runs.filter(F.col("failure_id") == failure_id))
        .orderBy("created_at", "id")
        .limit(max(1, min(limit, 500)))
    )


def citations(failures: DataFrame) -> DataFrame:
    """(failure_id, position, cited_id): the first cited ids of every failure."""
    named = F.filter(F.col("cited_failure_ids"), lambda x: x != "")
    return failures.select(
        F.col("id").alias("failure_id"),
        F.posexplode(F.slice(named, 1, S.CITED_LIMIT)).alias("position", "cited_id"),
    )


def cited_failures(citing: DataFrame, failures: DataFrame, keep=("status", "headline")) -> DataFrame:
    """Cited failures in cited order; unknown ids are dropped, the score is 1."""
    cited = failures.select(F.col("id").alias("cited_id"), *keep)
    return citations(citing).join(cited, "cited_id").withColumn("score", F.lit(1.0))


def failure_detail(failures: DataFrame, runs: DataFrame) -> DataFrame:
    """Failure, audit rows and citations as one long table.

    ``section`` is failure, run or citation and ``position`` orders a section.
    The long form never gathers one failure's audit rows into a single row.
    """
    none = F.lit(None)
    head = failures.select(
        F.col("id").alias("failure_id"), F.lit("failure").alias("section"),
        F.lit(0).cast("long").alias("position"), F.col("id").alias("item_id"),
        F.col("status").alias("status"), F.col("headline").alias("detail"),
    )
    trail = scan_runs(runs).join(failures.select(F.col("id").alias("failure_id")), "failure_id", "left_semi").select(
        "failure_id", F.lit("run").alias("section"), F.col("created_at").alias("position"),
        F.col("id").alias("item_id"), "status", F.coalesce("detail", none.cast("string")).alias("detail"),
    )
    cited = cited_failures(failures, failures).select(
        "failure_id", F.lit("citation").alias("section"),
        F.col("position").cast("long").alias("position"), F.col("cited_id").alias("item_id"),
        "status", F.col("headline").alias("detail"),
    )
    return head.unionByName(trail).unionByName(cited)


# ---- updates -----------------------------------------------------------------
def latest_per_id(updates: DataFrame, columns, order) -> DataFrame:
    """Last update of each id, as struct column ``u``."""
    return updates.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("u"))


def update_by_id(failures: DataFrame, updates: DataFrame, columns, order=("at",)) -> DataFrame:
    """Replace ``columns`` of the failures that have an update; all others are kept."""
    joined = failures.join(latest_per_id(updates, columns, order), "id", "left")
    hit = F.col("u").isNotNull()
    return joined.select(
        *[
            F.when(hit, F.col(f"u.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in failures.columns
        ]
    )


TRIAGE_COLUMNS = [
    "root_cause", "suggested_fix", "confidence", "headline", "is_likely_flake", "cited_failure_ids",
    "status",
]


def apply_triage(failures: DataFrame, results: DataFrame) -> DataFrame:
    return update_by_id(failures, results, TRIAGE_COLUMNS)


def checked_resolutions(resolutions: DataFrame) -> DataFrame:
    """Resolutions (id, note, at) with a trimmed note; blank or overlong notes are refused."""
    note = trim("note")
    return resolutions.withColumn("note", note).filter(
        (F.col("note") != "") & (F.length("note") <= S.NOTE_CHARS)
    )


def mark_resolved(failures: DataFrame, resolutions: DataFrame) -> DataFrame:
    closed = checked_resolutions(resolutions).select(
        "id", F.lit("resolved").alias("status"), F.col("note").alias("resolution_note"),
        F.col("at").alias("resolved_at"), "at",
    )
    return update_by_id(failures, closed, ["status", "resolution_note", "resolved_at"])


def resolve_audit(resolutions: DataFrame, failures: DataFrame) -> DataFrame:
    """Closing audit rows that belong with ``mark_resolved``."""
    known = failures.select("id")
    return checked_resolutions(resolutions).join(known, "id", "left_semi").select(
        F.col("id").alias("failure_id"), "workflow_id", F.lit("resolve").alias("step"),
        F.lit("ok").alias("status"), F.substring("note", 1, S.DETAIL_CHARS).alias("detail"),
        F.lit(None).cast("long").alias("duration_ms"), F.col("at").alias("created_at"),
    )


def set_status(failures: DataFrame, updates: DataFrame) -> DataFrame:
    return update_by_id(failures, updates, ["status"])


def bump_occurrences(failures: DataFrame, repeats: DataFrame) -> DataFrame:
    """Add repeats (id, seen_at); ``last_seen_at`` never moves back."""
    seen = repeats.groupBy("id").agg(F.count("*").alias("n"), F.max("seen_at").alias("seen"))
    joined = failures.join(seen, "id", "left")
    change = {
        "occurrence_count": F.col("occurrence_count") + F.coalesce("n", F.lit(0)),
        "last_seen_at": F.greatest("last_seen_at", F.coalesce("seen", "last_seen_at")),
    }
    return joined.select(*[change.get(c, F.col(c)).alias(c) for c in failures.columns])


REFRESHED = ["last_seen_at", "embedding"]


def arrivals(incoming: DataFrame, columns: list[str], order: str = "seq") -> DataFrame:
    """Per id its first row and the refreshed columns of its newest one."""
    first = F.min_by(F.struct(*columns), F.col(order)).alias("first")
    newest = F.max_by(F.struct(*REFRESHED), F.col(order)).alias("newest")
    return incoming.groupBy("id").agg(first, newest)


def upsert_failures(existing: DataFrame, incoming: DataFrame, order: str = "seq") -> DataFrame:
    """Insert new ids; a known id only takes the newest arrival's last_seen_at and embedding."""
    columns = existing.columns
    fresh = arrivals(incoming, columns, order)
    old = existing.select("id", F.struct(*columns).alias("old"))
    joined = old.join(fresh, "id", "full_outer")
    return joined.select(
        *[
            F.coalesce(f"newest.{c}", f"old.{c}").alias(c)
            if c in REFRESHED
            else F.when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(f"first.{c}")).alias(c)
            for c in columns
        ]
    )


def audit_rows(steps: DataFrame) -> DataFrame:
    """Audit rows ready to append: a fresh id and a bounded detail."""
    return steps.select(
        F.expr("uuid()").alias("id"), "failure_id", "workflow_id", "step", "status",
        F.substring("detail", 1, S.DETAIL_CHARS).alias("detail"), "duration_ms", "created_at",
    )


def changed_failures(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids whose visible state differs between two snapshots."""
    seen = ["status", "occurrence_count", "last_seen_at", "category"]
    a = before.select("id", F.struct(*seen).alias("a"))
    b = after.select("id", F.struct(*seen).alias("b"))
    joined = a.join(b, "id", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    change = (
        F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    )
    return joined.select("id", change.alias("change"))
