"""Table schemas and the limits that are part of the query semantics."""

from pyspark.sql import types as T

FAILURES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("repo", T.StringType(), False),
    T.StructField("branch", T.StringType(), False),
    T.StructField("provider", T.StringType(), False),
    T.StructField("pipeline_id", T.StringType(), False),
    T.StructField("job_name", T.StringType(), False),
    T.StructField("run_url", T.StringType(), True),
    T.StructField("commit_sha", T.StringType(), True),
    T.StructField("signature_hash", T.StringType(), False),
    T.StructField("signature_text", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("file_hint", T.StringType(), True),
    T.StructField("excerpt", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), False),
    T.StructField("signature_confidence", T.DoubleType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("root_cause", T.StringType(), True),
    T.StructField("suggested_fix", T.StringType(), True),
    T.StructField("confidence", T.DoubleType(), True),
    T.StructField("headline", T.StringType(), True),
    T.StructField("is_likely_flake", T.BooleanType(), False),
    T.StructField("cited_failure_ids", T.ArrayType(T.StringType()), False),
    T.StructField("resolution_note", T.StringType(), True),
    T.StructField("resolved_at", T.LongType(), True),
    T.StructField("occurrence_count", T.LongType(), False),
    T.StructField("created_at", T.LongType(), False),
    T.StructField("last_seen_at", T.LongType(), False),
])

RUNS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("failure_id", T.StringType(), False),
    T.StructField("workflow_id", T.StringType(), False),
    T.StructField("step", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("detail", T.StringType(), True),
    T.StructField("duration_ms", T.LongType(), True),
    T.StructField("created_at", T.LongType(), False),
])

DELIVERIES = T.StructType([
    T.StructField("delivery_id", T.StringType(), False),
    T.StructField("received_at", T.LongType(), False),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("raw_body", T.StringType(), True),
])

# every failure column but the vector: no report needs it, so no scan reads it
FAILURE_COLUMNS = [f.name for f in FAILURES if f.name != "embedding"]

# fixed values
PROVIDERS = ["github", "jenkins", "gitlab", "manual"]
CATEGORIES = [
    "test_failure", "compile_error", "dependency_error", "infra_timeout", "oom",
    "lint_error", "permission_error", "network_error", "unknown",
]
STATUSES = ["open", "awaiting_approval", "triaged", "resolved", "dismissed"]
OPEN_STATUSES = ["open", "awaiting_approval", "triaged"]
CLOSED_STATUSES = ["resolved", "dismissed"]
RUN_STATUSES = ["started", "ok", "error"]
FLAKY_CATEGORIES = ["infra_timeout", "network_error", "oom"]

MINUTE_MS = 60_000
HOUR_MS = 60 * MINUTE_MS
DAY_MS = 24 * HOUR_MS

TAIL_LINES = 2000
TAIL_CHARS = 512_000
CANDIDATE_LINES = 200
CANDIDATE_LINE_CHARS = 4000
EXCERPT_CHARS = 4000
EXCERPT_BEFORE = 6
EXCERPT_AFTER = 34
SIGNATURE_LINES = 5
SIGNATURE_LINE_CHARS = 240
SIGNATURE_LOOKAHEAD = 24
HINT_BEFORE = 20
FALLBACK_HINT_LINES = 40
HASH_CHARS = 32

EMBEDDING_DIMS = 384
SIMILARITY_THRESHOLD = 0.75
RESOLVED_CANDIDATES = 192
UNRESOLVED_CANDIDATES = 64
MAX_NEIGHBOURS = 25
MEMORY_K = 5
EMBED_CHARS = 1600
EMBED_BATCH = 50

FLAKE_MIN = 3
TOP_FLAKES = 10
CITED_LIMIT = 8

STALE_CLAIM_MS = 10 * MINUTE_MS
RECENT_TRIAGE_MS = 15 * MINUTE_MS
CLAIM_RETENTION_MS = DAY_MS
APPROVAL_WINDOW_MS = HOUR_MS
HISTORY_MESSAGES = 50
MESSAGE_CHARS = 8000
NEIGHBOUR_EXCERPT_CHARS = 1200

BODY_CHARS = 1_000_000
NOTE_CHARS = 4000
DETAIL_CHARS = 2000
REPO_CHARS = 200


def conform(df, schema):
    """Select the schema's columns in order and type; a missing column is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])
