"""Every registered query, with the SQL that checks it."""

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.functions import signature as sig
from faultline.functions import variants as V
from faultline.functions.text import present
from faultline.operators import (
    claims, context, dashboard, failures, fingerprint, history, ingest, replies, rollup, stats,
    transcripts, triage, vectors,
)
from faultline.plans import catalog, oracle_sql as O, views
from faultline.plans.catalog import Tables, query
from faultline.sources import parted
from faultline.sources.checkpoints import checkpoint_dir

catalog.SHARED.update(O.SHARED)
NOW = views.NOW_MS
DIMS, MIN_SCORE = 64, 0.2
WEEK = NOW - 30 * S.DAY_MS  # the test data spans one month


def listed(column: str) -> Column:
    """An array as text, so that results compare in any engine."""
    return F.array_join(column, ",").alias(column)


def failures_of(t: Tables) -> DataFrame:
    return failures.parse_cited_ids(t.failures)


# ---- fingerprint ---------------------------------------------------------------
def flaky_signatures(t: Tables) -> DataFrame:
    """Raw logs to the most repeated signatures of each repository."""
    logs = t.logs.withColumn("repo", F.concat(F.lit("acme/repo-"), F.pmod("log_id", F.lit(20))))
    seen = fingerprint.fingerprint_logs(logs, keep=("log_id", "repo")).select(
        "repo", F.col("hash").alias("signature_hash"), F.col("text").alias("signature_text"),
        F.lit(1).cast("long").alias("occurrence_count"), F.lit(NOW).alias("last_seen_at"),
    )
    return stats.top_flakes(seen, NOW)


query("flaky_signatures", """
SELECT repo, hash AS signature_hash, text AS signature_text, cast(n AS BIGINT) AS count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, hash) AS rank FROM (
    SELECT 'acme/repo-' || log_id % 20 AS repo, hash, min(text) AS text, count(*) AS n
    FROM sh_signatures GROUP BY ALL HAVING count(*) >= 3)) WHERE rank <= 10
""")(flaky_signatures)


@query("fingerprint_logs", "SELECT * FROM sh_signatures")
def _(t):
    return fingerprint.fingerprint_logs(t.logs)


@query("log_tail", """
SELECT log_id, len(w) AS n_lines, sha256(array_to_string(w, chr(10))) AS digest, len(l) AS cut_lines, sha256(array_to_string(l, chr(10))) AS cut_digest FROM (
  SELECT log_id, string_split(right(log_text, 512000), chr(10))[-2001:] AS w, string_split(right(log_text, 200), chr(10))[-6:] AS l FROM fx_logs)
""")
def _(t):
    both = t.logs.select("log_id", sig.tail_lines("log_text").alias("lines"), sig.tail_lines("log_text", 5, 200).alias("cut"))
    return both.select(
        "log_id",
        F.size("lines").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("digest"),
        F.size("cut").alias("cut_lines"), F.sha2(F.array_join("cut", "\n"), 256).alias("cut_digest"),
    )


@query("normalise_lines", "SELECT log_id, i, n AS normalised FROM sh_normal")
def _(t):
    lines = fingerprint.exploded_lines(t.logs)
    return fingerprint.normalise_lines(lines).select("log_id", "i", "normalised")


@query("prescreen_lines", "SELECT log_id, i, line FROM sh_candidates")
def _(t):
    return fingerprint.prescreen_lines(t.logs)


@query("classify_logs", f"""
SELECT log_id, m AS line_index, priority, {O.rule_field('rule', 0)} AS category,
  cast({O.rule_field('rule', 2)} AS DOUBLE) AS confidence FROM sh_best
""")
def _(t):
    return fingerprint.classify_logs(t.logs)


@query("drop_noise_lines", f"SELECT log_id, i, n AS normalised FROM sh_normal WHERE n <> '' AND NOT {O.noise('n')}")
def _(t):
    lines = fingerprint.normalise_lines(fingerprint.exploded_lines(t.logs))
    return fingerprint.drop_noise_lines(lines).select("log_id", "i", "normalised")


def part_of_signature(t: Tables, field: str) -> DataFrame:
    return fingerprint.fingerprint_logs(t.logs).select("log_id", field)


@query("signature_text", "SELECT log_id, text FROM sh_signatures")
def _(t):
    return part_of_signature(t, "text")


@query("log_excerpt", "SELECT log_id, excerpt FROM sh_signatures")
def _(t):
    return part_of_signature(t, "excerpt")


@query("file_hints", "SELECT log_id, file_hint FROM sh_signatures")
def _(t):
    return part_of_signature(t, "file_hint")


@query("signature_hash", """
SELECT id, substring(sha256(category || chr(10) || signature_text), 1, 32) AS hash FROM fx_failures
""")
def _(t):
    return t.failures.select("id", sig.signature_hash("category", "signature_text").alias("hash"))


@query("fallback_signatures", """
SELECT log_id, substring(sha256('unknown' || chr(10) || text), 1, 32) AS hash, text, 'unknown' AS category,
  file_hint, excerpt, cast(0.2 AS DOUBLE) AS confidence FROM sh_fallback
""")
def _(t):
    return fingerprint.fallback_signatures(t.logs)


@query("fingerprint_documents", "SELECT * FROM sd_signatures")
def _(t):
    """Whole documents as logs: almost all take the fallback branch."""
    docs = t.raw("documents").select(F.col("doc_id").alias("log_id"), F.col("text").alias("log_text"))
    return fingerprint.fingerprint_logs(docs)


# ---- ingest --------------------------------------------------------------------
@query("scan_deliveries", f"SELECT delivery_id, raw_body, {O.reason()} AS reason FROM sh_payloads")
def _(t):
    return ingest.scan_deliveries(t.deliveries)


@query("guard_body_size", "SELECT delivery_id, length(raw_body) <= 300 AS accepted FROM fx_deliveries")
def _(t):
    return ingest.guard_body_size(t.deliveries, 300).select("delivery_id", "accepted")


@query("detect_provider", f"SELECT delivery_id, {O.provider()} AS provider FROM sh_payloads WHERE j IS NOT NULL")
def _(t):
    return ingest.detect_provider(t.deliveries)


@query("extract_log_text", f"SELECT delivery_id, coalesce({O.text_at('j', *O.LOG, 'build.log', 'build_log')}, '') AS log_text FROM sh_payloads WHERE j IS NOT NULL")
def _(t):
    return ingest.extract_log_text(t.deliveries, "build.log", "build_log")


def register_adapter(provider: str):
    query(f"ingest_{provider}", f"SELECT * FROM sh_{provider}")(
        lambda t: ingest.adapt(t.deliveries, provider)
    )


for _provider in S.PROVIDERS:
    register_adapter(_provider)

_cols = ["provider", "repo", "branch", "pipeline_id", "job_name", "run_url", "commit_sha", "author", "log_text"]
_picked = ", ".join(
    f"CASE WHEN a.delivery_id IS NOT NULL THEN a.{c} ELSE m.{c} END AS {c}" for c in _cols
)


@query("normalise_deliveries", f"""
WITH p AS (SELECT *, CASE WHEN j IS NOT NULL THEN {O.provider()} END AS detected, {O.reason()} AS reason FROM sh_payloads),
a AS (SELECT 'github' AS by, * FROM sh_github UNION ALL SELECT 'jenkins', * FROM sh_jenkins UNION ALL SELECT 'gitlab', * FROM sh_gitlab)
SELECT p.delivery_id, received_at, reason, detected,
  CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN a.delivery_id IS NULL AND m.delivery_id IS NULL THEN 'ignored' ELSE 'accepted' END AS outcome,
  {_picked},
  CASE WHEN a.delivery_id IS NOT NULL THEN coalesce(a.occurred_at, received_at) WHEN m.delivery_id IS NOT NULL THEN coalesce(m.occurred_at, received_at) END AS occurred_at,
  coalesce(json_type(j, '$.requireApproval') = 'BOOLEAN' AND json_extract_string(j, '$.requireApproval') = 'true', false) AS require_approval
FROM p LEFT JOIN a ON p.delivery_id = a.delivery_id AND p.detected = a.by LEFT JOIN sh_manual m ON m.delivery_id = p.delivery_id
""")
def _(t):
    return ingest.normalise_deliveries(t.deliveries)


# (how a text is written, its SQL value from the second, the minute and the day)
_written = [
    ("EEE, dd MMM yyyy HH:mm:ss 'GMT'", "second"),
    ("dd MMM yyyy HH:mm:ss '+0530'", "second - 19800000"),
    ("MMM d, yyyy h:mm a 'EST'", "minute + 18000000"),
    ("yyyy/MM/dd HH:mm:ss", "second"),
    ("M/d/yyyy", "day"),
    ("EEE MMM dd yyyy HH:mm:ss 'GMT+0100 (Central European Time)'", "second - 3600000"),
    ("dd-MMM-yyyy HH:mm:ss 'PDT'", "second + 25200000"),
    ("'soon, on day' d", "NULL"),
]


@query("date_texts", f"""
SELECT event_id, cast(CASE event_id % 8 {' '.join(f'WHEN {i} THEN {value}' for i, (_, value) in enumerate(_written))} END AS BIGINT) AS at_ms
FROM (SELECT event_id, epoch_ms(date_trunc('second', ts)) AS second, epoch_ms(date_trunc('minute', ts)) AS minute,
  epoch_ms(date_trunc('day', ts)) AS day FROM events)
""")
def _(t):
    kinds = [F.when(F.col("event_id") % 8 == i, F.date_format("ts", form)) for i, (form, _) in enumerate(_written)]
    return t.raw("events").select("event_id", V.text_millis(F.coalesce(*kinds)).alias("at_ms"))


@query("to_epoch_ms", f"""
SELECT event_id, floor(CASE WHEN value < 1e12 THEN value * 1000 ELSE value END + 0.5)::BIGINT AS from_number,
  {views.DuckDialect.millis('ts')} AS from_text,
  CASE WHEN event_id < 1e12 THEN event_id * 1000 ELSE event_id END AS from_digits,
  cast(NULL AS BIGINT) AS from_word FROM events
""")
def _(t):
    ts = F.regexp_replace(F.col("ts").cast("string"), " ", "T")
    return t.raw("events").select(
        "event_id",
        V.number_millis("value").alias("from_number"),
        V.text_millis(F.concat(ts, F.lit("Z"))).alias("from_text"),
        V.text_millis(F.concat(F.lit(" "), F.col("event_id").cast("string"))).alias("from_digits"),
        V.text_millis(F.col("event_type")).alias("from_word"),
    )


@query("clean_branch", f"SELECT event_id, {O.branch(chr(39) + 'refs/heads/origin/ ' + chr(39) + ' || event_type || ' + chr(39) + ' ' + chr(39))} AS branch, {O.branch('CASE WHEN user_id % 2 = 0 THEN event_type END')} AS maybe FROM events")
def _(t):
    raw = F.concat(F.lit("refs/heads/origin/ "), F.col("event_type"), F.lit(" "))
    return t.raw("events").select(
        "event_id",
        ingest.clean_branch(raw).alias("branch"),
        ingest.clean_branch(F.when(F.col("user_id") % 2 == 0, F.col("event_type"))).alias("maybe"),
    )


@query("repo_from_scm", f"""
SELECT page_id, {O.scm('url')} AS repo, {O.scm("'git@host:' || page_id || '/x.git//'")} AS ssh FROM pages
""")
def _(t):
    ssh = F.concat(F.lit("git@host:"), F.col("page_id").cast("string"), F.lit("/x.git//"))
    return t.raw("pages").select(
        "page_id", ingest.repo_from_scm("url").alias("repo"), ingest.repo_from_scm(ssh).alias("ssh")
    )


_inner, _outer = views.pads(views.SECRET)
_given = O.header(*ingest.SIGNATURE_HEADERS)
_hexed = f"lower(regexp_replace({O.trim(_given)}, '(?i)^sha256=', ''))"


@query("verify_deliveries", f"""
SELECT delivery_id, coalesce(regexp_matches({_hexed}, '^[0-9a-f]+$') AND {_hexed} = {views.DuckDialect.hmac('raw_body', _inner, _outer)}, false) AS verified FROM fx_deliveries
""")
def _(t):
    return ingest.verify_deliveries(t.deliveries, views.SECRET)


@query("valid_ids", f"""
SELECT id, repo, regexp_matches({O.trim('id')}, '^[A-Za-z0-9_-]{{1,64}}$') AS id_ok,
  coalesce({O.trim('repo')} <> '' AND length({O.trim('repo')}) <= 200, false) AS repo_ok
FROM (SELECT url AS id, html AS repo FROM pages UNION ALL SELECT ' ' || id || ' ', signature_text FROM fx_failures)
""")
def _(t):
    pages = t.raw("pages").select(F.col("url").alias("id"), F.col("html").alias("repo"))
    ids = t.failures.select(F.concat(F.lit(" "), "id", F.lit(" ")).alias("id"), F.col("signature_text").alias("repo"))
    return ingest.valid_ids(pages.union(ids))


# ---- failures and audit -----------------------------------------------------------
_scan = ", ".join("array_to_string(cited_failure_ids, ',') AS cited_failure_ids" if c == "cited_failure_ids" else c for c in S.FAILURE_COLUMNS)


@query("scan_failures", f"SELECT {_scan} FROM sh_failures")
def _(t):
    out = failures.scan_failures(t.failures)
    return out.withColumn("cited_failure_ids", listed("cited_failure_ids"))


@query("scan_triage_runs", """
SELECT * REPLACE (CASE WHEN status IN ('started', 'ok', 'error') THEN status ELSE 'error' END AS status) FROM fx_runs
""")
def _(t):
    return failures.scan_runs(t.runs)


@query("parse_cited_ids", "SELECT id, array_to_string(cited_failure_ids, ',') AS cited_failure_ids, len(cited_failure_ids) AS n FROM sh_failures")
def _(t):
    return failures_of(t).select("id", listed("cited_failure_ids"), F.size("cited_failure_ids").alias("n"))


_kept = ", ".join(
    f"CASE WHEN old.id IS NULL THEN fresh.{c} ELSE old.{c} END AS {c}" for c in S.FAILURE_COLUMNS
    if c not in ("last_seen_at", "cited_failure_ids")
)


@query("upsert_failures", f"""
WITH old AS (SELECT *, [occurrence_count + 0.5, signature_confidence] AS e FROM sh_failures),
fresh AS (SELECT * REPLACE ('f-' || cast(pipeline_id AS BIGINT) * 2 AS id, 'acme/new' AS repo, last_seen_at + 1000 AS last_seen_at) FROM old)
SELECT {_kept}, array_to_string(CASE WHEN old.id IS NULL THEN fresh.cited_failure_ids ELSE old.cited_failure_ids END, ',') AS cited_failure_ids,
  coalesce(fresh.last_seen_at, old.last_seen_at) AS last_seen_at, CASE WHEN fresh.id IS NULL THEN old.e ELSE [9.5, 1, -1] END AS vector
FROM old FULL JOIN fresh ON old.id = fresh.id
""")
def _(t):
    old, fresh = arriving(t)
    return whole_rows(failures.upsert_failures(old, fresh))


def arriving(t) -> tuple[DataFrame, DataFrame]:
    """A table of failures and rows that arrive: half of their ids are known, half are new."""
    values = [F.col("occurrence_count") + 0.5, F.col("signature_confidence")]
    old = failures_of(t).withColumn("embedding", F.array(*[x.cast("float") for x in values]))
    fresh = old.select(
        *[F.col(c) for c in old.columns if c not in ("id", "repo", "last_seen_at", "embedding")],
        F.concat(F.lit("f-"), F.col("pipeline_id").cast("long") * 2).alias("id"),
        F.lit("acme/new").alias("repo"), (F.col("last_seen_at") + 1000).alias("last_seen_at"),
        F.array(*[F.lit(x).cast("float") for x in (9.5, 1.0, -1.0)]).alias("embedding"), F.col("last_seen_at").alias("seq"),
    )
    return old, fresh


def whole_rows(table: DataFrame) -> DataFrame:
    vector = F.transform("embedding", lambda x: F.round(x.cast("double"), 6))
    return table.select(
        *[listed(c) if c == "cited_failure_ids" else c for c in S.FAILURE_COLUMNS], vector.alias("vector")
    )


@query("merge_parts")
def _(t):
    """The same upsert into the table in parts by id."""
    old, fresh = arriving(t)
    path = f"{checkpoint_dir(t.spark)}/parts-{uuid4().hex}"
    manifest = parted.merge(t.spark, parted.write_table(old, path), fresh, path)
    return whole_rows(parted.read_table(t.spark, manifest))


catalog.ORACLES["merge_parts"] = catalog.ORACLES["upsert_failures"]


@query("append_audit", """
SELECT failure_id, 'w' AS workflow_id, 'analyse' AS step, 'ok' AS status, substring(reply, 1, 2000) AS detail,
  cast(attempt AS BIGINT) AS duration_ms, cast(0 AS BIGINT) AS created_at FROM fx_replies
""")
def _(t):
    steps = t.replies.select(
        "failure_id", F.lit("w").alias("workflow_id"), F.lit("analyse").alias("step"),
        F.lit("ok").alias("status"), F.col("reply").alias("detail"),
        F.col("attempt").cast("long").alias("duration_ms"), F.lit(0).cast("long").alias("created_at"),
    )
    return failures.audit_rows(steps).drop("id")


def resolutions(t: Tables) -> DataFrame:
    return t.replies.select(
        F.col("failure_id").alias("id"), F.col("reply").alias("note"),
        (F.col("attempt") * 1000).cast("long").alias("at"), F.lit("w").alias("workflow_id"),
    )


_notes = f"(SELECT failure_id AS id, {O.trim('reply')} AS note, cast(attempt * 1000 AS BIGINT) AS at_ms FROM fx_replies WHERE {O.trim('reply')} <> '' AND length({O.trim('reply')}) <= 4000)"


@query("mark_resolved", f"""
SELECT f.id, CASE WHEN u.id IS NULL THEN status ELSE 'resolved' END AS status,
  CASE WHEN u.id IS NULL THEN resolution_note ELSE u.note END AS resolution_note,
  CASE WHEN u.id IS NULL THEN resolved_at ELSE u.at_ms END AS resolved_at
FROM fx_failures f LEFT JOIN (SELECT id, arg_max(note, at_ms) AS note, max(at_ms) AS at_ms FROM {_notes} GROUP BY id) u ON f.id = u.id
""")
def _(t):
    out = failures.mark_resolved(failures_of(t), resolutions(t))
    return out.select("id", "status", "resolution_note", "resolved_at")


@query("resolve_with_audit", f"""
SELECT id AS failure_id, 'w' AS workflow_id, 'resolve' AS step, 'ok' AS status, substring(note, 1, 2000) AS detail,
  cast(NULL AS BIGINT) AS duration_ms, at_ms AS created_at FROM {_notes} WHERE id IN (SELECT id FROM fx_failures)
""")
def _(t):
    return failures.resolve_audit(resolutions(t), t.failures)


@query("get_failure", "SELECT id, repo, status, last_seen_at FROM fx_failures WHERE id = 'f-7'")
def _(t):
    return failures.get_failure(t.failures, "f-7").select("id", "repo", "status", "last_seen_at")


@query("recent_failures", "SELECT id, repo, last_seen_at FROM fx_failures WHERE repo = 'acme/repo-3' ORDER BY last_seen_at DESC, id LIMIT 25")
def _(t):
    return failures.recent_failures(t.failures, "acme/repo-3", 25).select("id", "repo", "last_seen_at")


@query("apply_triage", """
SELECT f.id, CASE WHEN u.failure_id IS NULL THEN root_cause ELSE 'cause ' || u.attempt END AS root_cause,
  CASE WHEN u.failure_id IS NULL THEN confidence ELSE cast(u.attempt AS DOUBLE) END AS confidence,
  CASE WHEN u.failure_id IS NULL THEN array_to_string(cited_failure_ids, ',') ELSE f.id END AS cited_failure_ids,
  CASE WHEN u.failure_id IS NULL THEN status ELSE 'triaged' END AS status
FROM sh_failures f LEFT JOIN (SELECT failure_id, max(attempt) AS attempt FROM fx_objects GROUP BY 1) u ON f.id = u.failure_id
""")
def _(t):
    results = t.objects.select(
        F.col("failure_id").alias("id"), F.concat(F.lit("cause "), "attempt").alias("root_cause"),
        F.lit("fix").alias("suggested_fix"), F.col("attempt").cast("double").alias("confidence"),
        F.lit("h").alias("headline"), F.lit(False).alias("is_likely_flake"),
        F.array("failure_id").alias("cited_failure_ids"), F.lit("triaged").alias("status"),
        F.col("attempt").alias("at"),
    )
    out = failures.apply_triage(failures_of(t), results)
    return out.select("id", "root_cause", "confidence", listed("cited_failure_ids"), "status")


@query("set_status", """
SELECT f.id, coalesce(CASE WHEN u.approved THEN 'triaged' WHEN NOT u.approved THEN 'dismissed' END, status) AS status
FROM fx_failures f LEFT JOIN (SELECT * FROM fx_approvals QUALIFY row_number() OVER (PARTITION BY failure_id ORDER BY ts DESC, event_id DESC) = 1) u ON f.id = u.failure_id
""")
def _(t):
    updates = t.approvals.select(
        F.col("failure_id").alias("id"), F.when(F.col("approved"), "triaged").otherwise("dismissed").alias("status"),
        F.struct("ts", "event_id").alias("at"),
    )
    return failures.set_status(failures_of(t), updates).select("id", "status")


@query("bump_occurrences", """
SELECT f.id, occurrence_count + coalesce(n, 0) AS occurrence_count, greatest(last_seen_at, coalesce(seen, last_seen_at)) AS last_seen_at
FROM fx_failures f LEFT JOIN (SELECT failure_id, count(*) AS n, max(ts) AS seen FROM fx_claims GROUP BY 1) u ON f.id = u.failure_id
""")
def _(t):
    repeats = t.claims.select(F.col("failure_id").alias("id"), F.col("ts").alias("seen_at"))
    out = failures.bump_occurrences(failures_of(t), repeats)
    return out.select("id", "occurrence_count", "last_seen_at")


@query("list_repos", "SELECT repo, max(last_seen_at) AS seen FROM fx_failures GROUP BY repo ORDER BY seen DESC, repo LIMIT 100")
def _(t):
    return failures.list_repos(t.failures)


@query("find_open_by_signature", """
SELECT f.id, f.repo, f.signature_hash, o.id AS open_failure_id, o.last_seen_at AS open_last_seen_at FROM fx_failures f LEFT JOIN (
  SELECT * FROM fx_failures WHERE status NOT IN ('resolved', 'dismissed')
  QUALIFY row_number() OVER (PARTITION BY repo, signature_hash ORDER BY last_seen_at DESC, id DESC) = 1) o
ON f.repo = o.repo AND f.signature_hash = o.signature_hash
""")
def _(t):
    incoming = t.failures.select("id", "repo", "signature_hash")
    return failures.find_open_by_signature(incoming, t.failures)


@query("repo_counts", f"""
SELECT repo, count(*) FILTER (status IN ('open', 'awaiting_approval', 'triaged')) AS open_count,
  count(*) FILTER (status = 'resolved') AS resolved_count FROM fx_failures WHERE last_seen_at >= {NOW - 7 * S.DAY_MS} GROUP BY repo
""")
def _(t):
    return stats.repo_counts(t.failures, NOW)


_flakes = f"""
SELECT repo, signature_hash, signature_text, cast(count AS BIGINT) AS count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY count DESC, seen DESC, signature_hash) AS rank FROM (
    SELECT repo, signature_hash, min(signature_text) AS signature_text, sum(occurrence_count) AS count, max(last_seen_at) AS seen
    FROM fx_failures WHERE last_seen_at >= {NOW - 7 * S.DAY_MS} GROUP BY repo, signature_hash HAVING sum(occurrence_count) >= 3)) WHERE rank <= 10
"""
catalog.SHARED["sh_flakes"] = _flakes
catalog.SHARED["sh_counts"] = f"""
SELECT repo, count(*) FILTER (status IN ('open', 'awaiting_approval', 'triaged')) AS open_count,
  count(*) FILTER (status = 'resolved') AS resolved_count FROM fx_failures WHERE last_seen_at >= {NOW - 7 * S.DAY_MS} GROUP BY repo
"""


@query("top_flakes", "SELECT * FROM sh_flakes")
def _(t):
    return stats.top_flakes(t.failures, NOW)


# a window that begins and ends within a day, after a last day that is not closed; a tenth of the rows came late
EDGE = views.NOW_MS - 5 * S.HOUR_MS - 13 * S.MINUTE_MS - 1
CLOSED = EDGE // S.DAY_MS * S.DAY_MS - S.DAY_MS


def closed_days(t):
    """Day partials as a stream writes them: one set from rows in time, one from late rows."""
    late = F.pmod(F.hash("id"), F.lit(10)) == 0
    closed = t.failures.filter(F.col("last_seen_at") < CLOSED)
    return rollup.day_partials(closed.filter(~late)).unionByName(rollup.day_partials(closed.filter(late)))


@query("top_flakes_from_days", _flakes.replace(str(NOW - 7 * S.DAY_MS), str(EDGE - 9 * S.DAY_MS)))
def _(t):
    return rollup.top_flakes(closed_days(t), t.failures, EDGE, CLOSED, 9)


@query("repo_counts_from_days", f"""
SELECT repo, count(*) FILTER (status IN ('open', 'awaiting_approval', 'triaged')) AS open_count,
  count(*) FILTER (status = 'resolved') AS resolved_count FROM fx_failures WHERE last_seen_at >= {EDGE - 9 * S.DAY_MS} GROUP BY repo
""")
def _(t):
    return rollup.repo_counts(closed_days(t), t.failures, EDGE, CLOSED, 9)


@query("repo_stats", """
SELECT c.repo, open_count, resolved_count, 7 AS window_days, coalesce(flakes, '') AS flakes FROM sh_counts c LEFT JOIN (
  SELECT repo, string_agg(signature_hash || ':' || count, ',' ORDER BY rank) AS flakes FROM sh_flakes GROUP BY repo) f ON f.repo = c.repo
""")
def _(t):
    flat = F.array_join(
        F.transform("top_flakes", lambda x: F.concat(x["signature_hash"], F.lit(":"), x["count"])), ","
    )
    return stats.repo_stats(t.failures, NOW).withColumn("flakes", flat).drop("top_flakes")


@query("flake_evidence", """
SELECT f.id, f.repo, f.signature_hash, k.count AS flake_count FROM fx_failures f
LEFT JOIN sh_flakes k ON f.repo = k.repo AND f.signature_hash = k.signature_hash
""")
def _(t):
    return stats.flake_evidence(t.failures, NOW).select("id", "repo", "signature_hash", "flake_count")


@query("audit_trail", """
SELECT id, step, CASE WHEN status IN ('started', 'ok', 'error') THEN status ELSE 'error' END AS status, detail, created_at
FROM fx_runs WHERE failure_id = 'f-12' ORDER BY created_at, id LIMIT 100
""")
def _(t):
    return failures.audit_trail(t.runs, "f-12").select("id", "step", "status", "detail", "created_at")


catalog.SHARED["sh_cited"] = """
SELECT failure_id, position, cited_id FROM (
  SELECT id AS failure_id, unnest(l) AS cited_id, generate_subscripts(l, 1) - 1 AS position FROM (
    SELECT id, list_filter(cited_failure_ids, lambda x: x <> '')[1:8] AS l FROM sh_failures))
"""


@query("cited_failures", """
SELECT failure_id, position, cited_id, f.status, f.headline, cast(1 AS DOUBLE) AS score FROM sh_cited JOIN fx_failures f ON f.id = cited_id
""")
def _(t):
    rows = failures_of(t)
    return failures.cited_failures(rows, rows)


@query("failure_detail", """
SELECT id AS failure_id, 'failure' AS section, cast(0 AS BIGINT) AS position, id AS item_id, status, headline AS detail FROM fx_failures
UNION ALL SELECT failure_id, 'run', created_at, id, CASE WHEN status IN ('started', 'ok', 'error') THEN status ELSE 'error' END, detail FROM fx_runs
UNION ALL SELECT failure_id, 'citation', position, cited_id, f.status, f.headline FROM sh_cited JOIN fx_failures f ON f.id = cited_id
""")
def _(t):
    return failures.failure_detail(failures_of(t), t.runs)


@query("count_failures", "SELECT count(*) AS n FROM fx_failures")
def _(t):
    return t.failures.agg(F.count("*").alias("n"))


@query("changed_failures", """
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM fx_failures a FULL JOIN (
  SELECT CASE WHEN branch = '' THEN 'new-' || id ELSE id END AS id, CASE WHEN branch = 'dev' THEN 'resolved' ELSE status END AS status,
    occurrence_count, last_seen_at, category FROM fx_failures) b ON a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR a.status <> b.status
""")
def _(t):
    now = t.failures.withColumn(
        "id", F.when(F.col("branch") == "", F.concat(F.lit("new-"), "id")).otherwise(F.col("id"))
    ).withColumn("status", F.when(F.col("branch") == "dev", "resolved").otherwise(F.col("status")))
    return failures.changed_failures(t.failures, now)


# ---- vectors --------------------------------------------------------------------
_unit = "list_transform(v, lambda x: CASE WHEN s > 0 THEN cast(x * (1 / sqrt(s)) AS FLOAT) ELSE cast(0 AS FLOAT) END)"


@query("normalise_vectors", f"""
SELECT id, position, round(cast(x AS DOUBLE), 5) AS x FROM (SELECT id, unnest(u) AS x, generate_subscripts(u, 1) - 1 AS position FROM (
  SELECT id, {_unit} AS u FROM (SELECT id, v, list_dot_product(v, v) AS s FROM (
    SELECT id, list_transform(vector, lambda x: cast(cast(x * 3 AS FLOAT) AS DOUBLE)) AS v FROM fx_vectors))))
""")
def _(t):
    tripled = t.vectors.select("id", F.transform("vector", lambda x: (x * 3).cast("float")).alias("vector"))
    out = vectors.normalise_vectors(tripled).select("id", F.posexplode("vector").alias("position", "x"))
    return out.withColumn("x", F.round(F.col("x").cast("double"), 5))


_dot = "round(list_dot_product(cast({a} AS DOUBLE[]), cast({b} AS DOUBLE[])), 6)"


@query("pair_similarity", f"""
SELECT a.id AS a_id, b.id AS b_id, {_dot.format(a='a.vector', b='b.vector')} AS score
FROM fx_vectors a JOIN fx_vectors b ON cast(substring(b.id, 3) AS BIGINT) = cast(substring(a.id, 3) AS BIGINT) + 1
""")
def _(t):
    n = F.substring("id", 3, 20).cast("long")
    a = t.vectors.select((n + 1).alias("n"), F.col("id").alias("a_id"), F.col("vector").alias("a"))
    b = t.vectors.select(n.alias("n"), F.col("id").alias("b_id"), F.col("vector").alias("b"))
    return vectors.pair_similarity(a.join(b, "n")).select("a_id", "b_id", F.round("score", 6).alias("score"))


catalog.SHARED["sh_memory"] = """
SELECT repo, bucket, rank, id, vector FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, bucket ORDER BY last_seen_at DESC, id) AS rank FROM (
    SELECT *, CASE WHEN status = 'resolved' THEN 0 ELSE 1 END AS bucket FROM fx_vectors WHERE status <> 'dismissed'))
WHERE rank <= CASE bucket WHEN 0 THEN 192 ELSE 64 END AND len(vector) = 64
"""
catalog.SHARED["sh_neighbours"] = f"""
SELECT query_id, repo, id, rank, score FROM (
  SELECT query_id, repo, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bucket, place) AS rank FROM (
    SELECT q.id AS query_id, q.repo, c.id, c.bucket, c.rank AS place,
      round(list_dot_product(cast(q.vector AS DOUBLE[]), cast(c.vector AS DOUBLE[])), 12) AS score
    FROM fx_vectors q JOIN sh_memory c ON q.repo = c.repo AND q.id <> c.id) WHERE score >= {MIN_SCORE}) WHERE rank <= 5
"""


@query("memory_candidates", "SELECT repo, bucket, rank, id FROM sh_memory")
def _(t):
    return vectors.memory_candidates(t.vectors, DIMS).select("repo", "bucket", "rank", "id")


def neighbours_of(t: Tables, hydrate=("status",)) -> DataFrame:
    asked = t.vectors.select(F.col("id").alias("query_id"), "repo", "vector")
    memory = t.vectors.select("*", F.concat(F.lit("cause of "), "id").alias("root_cause"))
    return vectors.search_similar(asked, memory, min_score=MIN_SCORE, dims=DIMS, hydrate=hydrate)


@query("top_k_similar", "SELECT query_id, repo, id, rank, round(score, 6) AS score FROM sh_neighbours")
def _(t):
    asked = t.vectors.select(F.col("id").alias("query_id"), "repo", "vector")
    hits = vectors.top_k_similar(asked, vectors.memory_candidates(t.vectors, DIMS), min_score=MIN_SCORE)
    return hits.withColumn("score", F.round("score", 6))


@query("search_similar", """
SELECT query_id, n.repo, n.id, rank, round(score, 6) AS score, v.status, v.signature_text FROM sh_neighbours n JOIN fx_vectors v ON v.id = n.id
""")
def _(t):
    return neighbours_of(t, ("status", "signature_text")).withColumn("score", F.round("score", 6))


@query("trim_neighbours", """
SELECT query_id, n.id, rank, substring(repeat('line of ' || n.id || ' ', 200), 1, 1200) AS excerpt FROM sh_neighbours n
""")
def _(t):
    long = F.repeat(F.concat(F.lit("line of "), "id", F.lit(" ")), F.lit(200))
    asked = t.vectors.select(F.col("id").alias("query_id"), "repo", "vector")
    near = vectors.search_similar(
        asked, t.vectors.withColumn("excerpt", long), min_score=MIN_SCORE, dims=DIMS, hydrate=("excerpt",)
    )
    return context.trim_neighbours(near).select("query_id", "id", "rank", "excerpt")


@query("missing_embeddings", """
SELECT id, signature_text FROM fx_vectors WHERE len(list_filter(vector, lambda x: x <> 0)) = 0 ORDER BY last_seen_at DESC, id LIMIT 50
""")
def _(t):
    return vectors.missing_embeddings(t.vectors)


@query("reembed", """
SELECT count(*) FILTER (a.zero AND NOT b.zero) AS embedded, count(*) FILTER (a.zero AND (b.zero OR b.id IS NULL)) AS remaining
FROM (SELECT id, len(list_filter(vector, lambda x: x <> 0)) = 0 AS zero FROM fx_vectors) a
LEFT JOIN (SELECT 'v-' || cast(substring(id, 3) AS BIGINT) * 2 AS id, len(list_filter(vector, lambda x: x <> 0)) = 0 AS zero FROM fx_vectors) b ON a.id = b.id
""")
def _(t):
    twice = (F.substring("id", 3, 20).cast("long") * 2).cast("string")
    fresh = t.vectors.select(F.concat(F.lit("v-"), twice).alias("id"), F.col("vector").alias("fresh"))
    return vectors.reembed_counts(vectors.reembed(t.vectors, fresh))


_input = f"substring({O.trim('replace(text, chr(13) || chr(10), chr(10))')}, 1, 1600)"


@query("embedding_inputs", f"SELECT doc_id, {_input} AS input, {_input} <> '' AS usable FROM documents")
def _(t):
    return vectors.embedding_inputs(t.raw("documents"), "text").select("doc_id", "input", "usable")


@query("validate_vectors", """
SELECT id, len(v) = 64 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = len(v) AS valid FROM (
  SELECT id, CASE vec_id % 6 WHEN 1 THEN vector[1:63] WHEN 2 THEN list_append(vector, 0) WHEN 3 THEN list_append(vector[2:64], 'nan'::FLOAT)
    WHEN 4 THEN list_append(vector[2:64], '-inf'::FLOAT) WHEN 5 THEN list_append(vector[2:64], NULL) ELSE vector END AS v
  FROM (SELECT *, cast(substr(id, 3) AS BIGINT) AS vec_id FROM fx_vectors))
""")
def _(t):
    number = F.substring("id", 3, 20).cast("long") % 6
    v = F.col("vector")

    def with_last(value):
        return F.concat(F.slice(v, 2, 63), F.array(F.lit(value).cast("float")))

    spoilt = (
        F.when(number == 1, F.slice(v, 1, 63)).when(number == 2, F.concat(v, F.array(F.lit(0.0).cast("float"))))
        .when(number == 3, with_last(float("nan"))).when(number == 4, with_last(float("-inf")))
        .when(number == 5, with_last(None)).otherwise(v)
    )
    return vectors.validate_vectors(t.vectors.withColumn("vector", spoilt), DIMS).select("id", "valid")


@query("embed_signatures", r"""
SELECT id, position, round(cast(cast(c * (1 / sqrt(sum(c * c) OVER (PARTITION BY id))) AS FLOAT) AS DOUBLE), 5) AS x FROM (
  SELECT id, cast('0x' || substring(md5(w), 1, 8) AS BIGINT) % 384 AS position, cast(count(*) AS DOUBLE) AS c FROM (
    SELECT id, unnest(regexp_split_to_array(lower(signature_text), '[^\p{L}\p{N}_]+')) AS w FROM fx_failures) WHERE w <> '' GROUP BY ALL)
""")
def _(t):
    out = vectors.embed_texts(t.failures.select("id", "signature_text"))
    values = out.select("id", F.posexplode("vector").alias("position", "x")).filter("x <> 0")
    return values.select("id", F.col("position").cast("long").alias("position"), F.round(F.col("x").cast("double"), 5).alias("x"))


@query("decode_vectors", f"""
SELECT id, 256 AS n_bytes, 64 AS dims, unnest(range(64)) AS position, round(cast(unnest(u) AS DOUBLE), 5) AS x FROM (
  SELECT id, {_unit} AS u FROM (SELECT id, v, list_dot_product(v, v) AS s FROM (
    SELECT id, list_transform(vector, lambda x: cast(x AS DOUBLE)) AS v FROM fx_vectors)))
""")
def _(t):
    coded = vectors.encode_vectors(t.vectors.select("id", "vector"), DIMS)
    return vectors.decode_vectors(coded, DIMS).select(
        "id", F.length("blob").alias("n_bytes"), F.size("decoded").alias("dims"),
        F.posexplode("decoded").alias("position", "x"),
    ).withColumn("x", F.round(F.col("x").cast("double"), 5))


# ---- claims, history ---------------------------------------------------------------
_same = "e.repo = r.repo AND e.signature_hash = r.signature_hash AND e.rn = r.rn + 1"
catalog.SHARED["sh_claim_rows"] = """
SELECT *, row_number() OVER (PARTITION BY repo, signature_hash ORDER BY ts, event_id) AS rn FROM fx_claims
"""
CLAIM_SQL = f"""
WITH RECURSIVE r AS (
  SELECT DISTINCT repo, signature_hash, cast(0 AS BIGINT) AS rn, cast(NULL AS VARCHAR) AS failure_id, cast(NULL AS BIGINT) AS ts,
    cast(NULL AS VARCHAR) AS kind, cast(NULL AS BIGINT) AS event_id, cast(NULL AS VARCHAR) AS verdict, cast(NULL AS VARCHAR) AS seen_by,
    cast(NULL AS VARCHAR) AS owner, cast(NULL AS BIGINT) AS claimed_at, cast(NULL AS BIGINT) AS completed_at FROM sh_claim_rows
  UNION ALL
  SELECT repo, signature_hash, rn, failure_id, ts, kind, event_id, verdict,
    CASE verdict WHEN 'new' THEN failure_id WHEN 'released' THEN failure_id WHEN 'in_flight' THEN o WHEN 'recently_triaged' THEN o END,
    CASE verdict WHEN 'new' THEN failure_id WHEN 'forgotten' THEN NULL ELSE o END,
    CASE verdict WHEN 'new' THEN ts WHEN 'forgotten' THEN NULL ELSE c END,
    CASE verdict WHEN 'released' THEN ts WHEN 'new' THEN NULL WHEN 'forgotten' THEN NULL ELSE d END
  FROM (
    SELECT *, CASE kind WHEN 'forget' THEN 'forgotten'
      WHEN 'release' THEN CASE WHEN o = failure_id THEN 'released' ELSE 'not_holder' END
      ELSE CASE WHEN o IS NOT NULL AND d IS NULL THEN 'in_flight' WHEN o IS NOT NULL AND ts - d < {S.RECENT_TRIAGE_MS} THEN 'recently_triaged' ELSE 'new' END END AS verdict
    FROM (
      SELECT e.*, CASE WHEN gone THEN NULL ELSE owner END AS o, CASE WHEN gone THEN NULL ELSE claimed_at END AS c, CASE WHEN gone THEN NULL ELSE completed_at END AS d
      FROM (SELECT e.repo, e.signature_hash, e.rn, e.failure_id, e.ts, e.kind, e.event_id, r.owner, r.claimed_at, r.completed_at,
          coalesce(CASE WHEN r.completed_at IS NULL THEN e.ts - r.claimed_at >= {S.STALE_CLAIM_MS} ELSE e.ts - r.completed_at > {S.CLAIM_RETENTION_MS} END, false) AS gone
        FROM r JOIN sh_claim_rows e ON {_same}) e))
)
"""


_verdicts = """
SELECT repo, signature_hash, failure_id, ts, kind, event_id, verdict, seen_by AS holder, claimed_at, completed_at FROM r WHERE rn > 0
"""


@query("claim_verdicts", CLAIM_SQL + _verdicts)
def _(t):
    return claims.claim_verdicts(t.claims)


# one key with a quarter of all events, without a pause, and claims that are forgotten all the time
_hot_key = "CASE WHEN repo = 'acme/repo-0' THEN 'hot' ELSE signature_hash END"
_storm_kind = "CASE WHEN event_id % 3 = 0 THEN 'forget' ELSE kind END"
for _name, _column, _value in (("hot", "signature_hash", _hot_key), ("storm", "kind", _storm_kind)):
    catalog.SHARED[f"sh_{_name}_rows"] = f"""
SELECT *, row_number() OVER (PARTITION BY repo, signature_hash ORDER BY ts, event_id) AS rn
FROM (SELECT * REPLACE ({_value} AS {_column}) FROM fx_claims)
"""


@query("claim_verdicts_hot", CLAIM_SQL.replace("sh_claim_rows", "sh_hot_rows") + _verdicts)
def _(t):
    return claims.claim_verdicts(t.claims.withColumn("signature_hash", F.expr(_hot_key)))


@query("claim_verdicts_storm", CLAIM_SQL.replace("sh_claim_rows", "sh_storm_rows") + _verdicts)
def _(t):
    return claims.claim_verdicts(t.claims.withColumn("kind", F.expr(_storm_kind)))


_current = """
SELECT repo, signature_hash, owner AS failure_id, claimed_at, completed_at FROM (
  SELECT * FROM r WHERE verdict IN ('new', 'released', 'forgotten')
  QUALIFY row_number() OVER (PARTITION BY repo, signature_hash ORDER BY ts DESC, event_id DESC) = 1) WHERE claimed_at IS NOT NULL
"""


@query("current_claims", CLAIM_SQL + _current)
def _(t):
    return claims.current_claims(claims.claim_verdicts(t.claims))


CLAIMS_NOW = 1_704_326_460_000


@query("repo_counters", CLAIM_SQL + f"""
SELECT f.repo, total_failures, total_resolved, last_failure_at, coalesce(in_flight, 0) AS in_flight FROM (
  SELECT repo, count(*) AS total_failures, count(*) FILTER (status = 'resolved') AS total_resolved, max(created_at) AS last_failure_at FROM fx_failures GROUP BY repo) f
LEFT JOIN (SELECT repo, count(*) FILTER (completed_at IS NULL AND claimed_at >= {CLAIMS_NOW - S.STALE_CLAIM_MS}) AS in_flight FROM ({_current}) GROUP BY repo) c ON c.repo = f.repo
""")
def _(t):
    held = claims.current_claims(claims.claim_verdicts(t.claims))
    return stats.repo_counters(t.failures, held, CLAIMS_NOW)


_history = "row_number() OVER (PARTITION BY repo ORDER BY id DESC)"


@query("trim_history", f"SELECT repo, id, role, substring(content, 1, 8000) AS content, created_at FROM fx_messages QUALIFY {_history} <= 50")
def _(t):
    return history.trim_history(t.messages)


@query("chat_history", f"""
SELECT repo, id, CASE WHEN role = 'assistant' THEN role ELSE 'user' END AS role, content, created_at FROM fx_messages QUALIFY {_history} <= 5
""")
def _(t):
    return history.chat_history(t.messages, 5)


@query("clear_history", "SELECT * FROM fx_messages WHERE repo NOT IN (SELECT repo FROM fx_messages WHERE role = 'system')")
def _(t):
    cleared = t.messages.filter(F.col("role") == "system").select("repo").distinct()
    return history.clear_history(t.messages, cleared)


# ---- triage ------------------------------------------------------------------------
def pending_of(t: Tables) -> DataFrame:
    verdict = (
        F.when(F.col("status") == "open", "in_flight")
        .when(F.col("status") == "resolved", "recently_triaged")
        .otherwise("new")
    )
    return t.failures.select(
        F.col("id").alias("failure_id"), F.col("last_seen_at").alias("pending_at"),
        verdict.alias("verdict"), (F.col("status") != "triaged").alias("require_approval"),
        "suggested_fix",
    )


catalog.SHARED["sh_outcomes"] = f"""
SELECT p.failure_id, pending_at, verdict, require_approval, suggested_fix, reviewer, edited_fix, approval,
  CASE WHEN verdict = 'in_flight' THEN 'duplicate_in_flight' WHEN verdict <> 'new' THEN verdict WHEN approval = 'rejected' THEN 'rejected' ELSE 'completed' END AS reason,
  CASE WHEN verdict <> 'new' THEN 'skipped' WHEN approval = 'rejected' THEN 'dismissed' ELSE 'triaged' END AS status,
  CASE WHEN verdict <> 'new' THEN NULL WHEN require_approval THEN 'awaiting_approval' ELSE 'triaged' END AS persisted_status
FROM (
  SELECT p.*, reviewer, edited_fix, CASE WHEN verdict <> 'new' OR NOT require_approval THEN 'not_required' WHEN approved THEN 'approved'
    WHEN NOT approved THEN 'rejected' ELSE 'timed_out' END AS approval
  FROM (SELECT id AS failure_id, last_seen_at AS pending_at, suggested_fix, status <> 'triaged' AS require_approval,
      CASE status WHEN 'open' THEN 'in_flight' WHEN 'resolved' THEN 'recently_triaged' ELSE 'new' END AS verdict FROM fx_failures) p
  LEFT JOIN (
    SELECT a.* FROM fx_approvals a JOIN fx_failures f ON f.id = a.failure_id
    WHERE a.ts BETWEEN f.last_seen_at AND f.last_seen_at + {S.APPROVAL_WINDOW_MS}
      AND f.status NOT IN ('open', 'resolved', 'triaged')
    QUALIFY row_number() OVER (PARTITION BY a.failure_id ORDER BY a.ts, a.event_id) = 1) d ON d.failure_id = p.failure_id) p
"""


@query("triage_outcomes", "SELECT * EXCLUDE (suggested_fix) FROM sh_outcomes")
def _(t):
    return triage.triage_outcomes(pending_of(t).drop("suggested_fix"), t.approvals)


@query("apply_approvals", f"""
SELECT failure_id, approval, CASE approval WHEN 'approved' THEN coalesce(nullif({O.trim('edited_fix')}, ''), suggested_fix)
  WHEN 'timed_out' THEN suggested_fix || chr(10) || chr(10) || '_Auto-posted: the 1 hour approval window expired without a reviewer decision._'
  ELSE suggested_fix END AS suggested_fix FROM sh_outcomes
""")
def _(t):
    out = triage.apply_approvals(triage.triage_outcomes(pending_of(t), t.approvals))
    return out.select("failure_id", "approval", "suggested_fix")


@query("assemble_failures", """
SELECT 'd-' || log_id AS id, 'acme/repo-' || log_id % 5 AS repo, hash AS signature_hash, text AS signature_text, category, file_hint, excerpt,
  384 AS dims, confidence AS signature_confidence, 'open' AS status, cast(1 AS BIGINT) AS occurrence_count, log_id AS created_at, log_id AS last_seen_at FROM sh_signatures
""")
def _(t):
    logs = t.logs.select(
        "*", F.concat(F.lit("d-"), "log_id").alias("delivery_id"),
        F.concat(F.lit("acme/repo-"), F.pmod("log_id", F.lit(5))).alias("repo"),
        F.lit("main").alias("branch"), F.lit("manual").alias("provider"), F.lit("1").alias("pipeline_id"),
        F.lit("job").alias("job_name"), F.lit(None).cast("string").alias("run_url"),
        F.lit(None).cast("string").alias("commit_sha"), F.col("log_id").alias("occurred_at"),
    )
    keep = ("delivery_id", "repo", "branch", "provider", "pipeline_id", "job_name", "run_url", "commit_sha", "occurred_at")
    rows = triage.assemble_failures(fingerprint.fingerprint_logs(logs, keep=keep))
    return rows.select(
        "id", "repo", "signature_hash", "signature_text", "category", "file_hint", "excerpt",
        F.size("embedding").alias("dims"), "signature_confidence", "status", "occurrence_count", "created_at", "last_seen_at",
    )


@query("step_attempts", """
SELECT failure_id, step, count(*) FILTER (status = 'started') AS attempts, count(*) FILTER (status = 'ok') AS succeeded,
  count(*) FILTER (status = 'error') AS failed, cast(coalesce(sum(duration_ms), 0) AS BIGINT) AS busy_ms,
  min(created_at) AS first_at, max(created_at) AS last_at, arg_max(status, (created_at, id)) AS last_status
FROM (SELECT * REPLACE (CASE WHEN status IN ('started', 'ok', 'error') THEN status ELSE 'error' END AS status) FROM fx_runs) GROUP BY 1, 2
""")
def _(t):
    return triage.step_attempts(failures.scan_runs(t.runs))


# rows that never start or end: some starts and some ends are lost
_lost = "CASE WHEN status = 'started' THEN cast(substr(id, 3, 1) AS INT) <> 7 ELSE length(failure_id) + coalesce(duration_ms, 0) % 5 <> 4 END"


@query("step_pairs", f"""
WITH runs AS (
  SELECT * REPLACE (CASE WHEN status IN ('started', 'ok', 'error') THEN status ELSE 'error' END AS status)
  FROM (SELECT * REPLACE (CASE WHEN id LIKE '%-4' THEN 'parse-log' ELSE step END AS step) FROM fx_runs WHERE {_lost})),
a AS (
  SELECT *, lead(status) OVER w AS next_status, lead(id) OVER w AS next_id, lead(created_at) OVER w AS next_at, lead(duration_ms) OVER w AS next_ms,
    lag(status) OVER w AS previous, sum(CASE WHEN status = 'started' THEN 1 ELSE 0 END) OVER w AS starts
  FROM runs WINDOW w AS (PARTITION BY failure_id, step ORDER BY created_at, id))
SELECT failure_id, step, cast(starts AS BIGINT) AS attempt, CASE next_status WHEN 'started' THEN 'abandoned' ELSE coalesce(next_status, 'open') END AS state,
  id AS started_id, CASE WHEN next_status <> 'started' THEN next_id END AS ended_id, created_at AS started_at,
  CASE WHEN next_status <> 'started' THEN next_at END AS ended_at, CASE WHEN next_status <> 'started' THEN next_ms END AS duration_ms
FROM a WHERE status = 'started'
UNION ALL
SELECT failure_id, step, NULL, 'unstarted', NULL, id, NULL, created_at, duration_ms FROM a WHERE status <> 'started' AND coalesce(previous, '') <> 'started'
""")
def _(t):
    step = F.when(F.col("id").like("%-4"), "parse-log").otherwise(F.col("step"))
    return triage.step_pairs(failures.scan_runs(t.runs.filter(_lost).withColumn("step", step)))


_posted = """'**' || headline || '**' || chr(10) || chr(10) || '**Root cause** — ' || root_cause || chr(10) || chr(10) || '**Suggested fix**' || chr(10)
  || suggested_fix || chr(10) || chr(10) || '_Triage · confidence ' || cast(floor(confidence * 100 + 0.5) AS BIGINT) || '%_'"""


@query("postback_outbox", f"""
SELECT id, run_url, CASE WHEN run_url IS NULL THEN 'no_run_url' ELSE 'no_credentials' END AS reason,
  'would POST triage to ' || run_url AS detail, cast(NULL AS VARCHAR) AS body FROM fx_failures
UNION ALL SELECT id, run_url, CASE WHEN run_url IS NULL THEN 'no_run_url' WHEN {_posted} IS NULL THEN 'no_result' ELSE 'ready' END, NULL,
  CASE WHEN run_url IS NOT NULL THEN {_posted} END FROM fx_failures
""")
def _(t):
    without = triage.postback_outbox(t.failures, False)
    return without.unionByName(triage.postback_outbox(t.failures, True))


# ---- replies ------------------------------------------------------------------------
@query("reply_text", """
SELECT failure_id, attempt, coalesce(CASE json_type(r) WHEN 'VARCHAR' THEN json_extract_string(r, '$') WHEN 'OBJECT' THEN coalesce(
  CASE WHEN json_type(r, '$.response') = 'VARCHAR' AND trim(json_extract_string(r, '$.response')) <> '' THEN json_extract_string(r, '$.response') END,
  CASE WHEN json_type(r, '$.response') = 'OBJECT' THEN cast(json_extract(r, '$.response') AS VARCHAR) END,
  CASE WHEN trim(json_extract_string(r, '$.choices[0].message.content')) <> '' THEN json_extract_string(r, '$.choices[0].message.content') END) END, '') AS reply_text
FROM (SELECT *, CASE WHEN json_valid(response) THEN cast(response AS JSON) END AS r FROM fx_replies)
""")
def _(t):
    return replies.reply_text(t.replies).select("failure_id", "attempt", "reply_text")


catalog.SHARED["sh_reply_objects"] = """
SELECT failure_id, attempt, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body
  WHEN json_valid(span) AND json_type(span) = 'OBJECT' THEN span END AS object, reply FROM (
  SELECT *, trim(reply) AS body, regexp_extract(reply, '\\{"rootCause".*\\}', 0, 's') AS span FROM fx_replies)
"""


@query("extract_reply_json", """
SELECT failure_id, attempt, object, json_extract_string(object, '$.rootCause') AS root_cause, object IS NOT NULL AS found FROM sh_reply_objects
""")
def _(t):
    out = replies.extract_reply_json(t.replies)
    cause = F.try_variant_get(F.try_parse_json("object"), "$.rootCause", "string")
    return out.select(
        "failure_id", "attempt", "object", cause.alias("root_cause"), F.col("object").isNotNull().alias("found")
    )


ALLOWED = ["f-1", "f-3", "f-9"]
_conf = """CASE WHEN json_type(object, '$.confidence') IN ('DOUBLE', 'UBIGINT') THEN cast(json_extract_string(object, '$.confidence') AS DOUBLE)
  WHEN json_type(object, '$.confidence') = 'VARCHAR' THEN try_cast(replace(json_extract_string(object, '$.confidence'), '%', '') AS DOUBLE)
    / CASE WHEN json_extract_string(object, '$.confidence') LIKE '%\\%%' ESCAPE '\\' THEN 100 ELSE 1 END END"""
_share = f"CASE WHEN {_conf} IS NULL THEN 0.5 ELSE least(greatest(CASE WHEN {_conf} > 1 AND {_conf} <= 100 THEN {_conf} / 100 ELSE {_conf} END, 0), 1) END"
_flake = """coalesce(CASE json_type(object, '$.isLikelyFlake') WHEN 'BOOLEAN' THEN json_extract_string(object, '$.isLikelyFlake') = 'true'
  WHEN 'UBIGINT' THEN json_extract_string(object, '$.isLikelyFlake') <> '0' WHEN 'VARCHAR' THEN
  CASE json_extract_string(object, '$.isLikelyFlake') WHEN 'no' THEN false WHEN 'yes' THEN true END END, category IN ('infra_timeout', 'network_error', 'oom'))"""
_ids = """CASE json_type(object, '$.citedFailureIds') WHEN 'ARRAY' THEN json_extract_string(object, '$.citedFailureIds[*]')
  WHEN 'VARCHAR' THEN regexp_split_to_array(json_extract_string(object, '$.citedFailureIds'), '[\\s,]+') ELSE [] END"""
_cited = f"array_to_string(list_filter(['f-1', 'f-3', 'f-9'], lambda x: list_contains({_ids}, x)), ',')"
_cause = f"coalesce(nullif({O.trim(chr(106) + 'c')}, ''), '{replies.NO_CAUSE}')"
catalog.SHARED["sh_objects"] = "SELECT *, good AS object, json_extract_string(good, '$.rootCause') AS jc, json_extract_string(good, '$.headline') AS jh FROM fx_objects"


def objects_of(t: Tables) -> DataFrame:
    allowed = F.array(*[F.lit(i) for i in ALLOWED])
    return t.objects.withColumn("object", F.col("good")).withColumn("allowed", allowed)


@query("coerce_triage", f"""
SELECT failure_id, attempt, {O.clip(_cause, 1200)} AS root_cause, {O.clip(O.trim("json_extract_string(object, '$.suggestedFix')"), 2000)} AS suggested_fix,
  {_share} AS confidence, {_flake} AS is_likely_flake, {_cited} AS cited_failure_ids,
  {O.clip(f"coalesce(nullif({O.trim('jh')}, ''), {_cause})", 120)} AS headline FROM sh_objects
""")
def _(t):
    out = replies.coerce_triage(objects_of(t), keep=("failure_id", "attempt"))
    return out.withColumn("cited_failure_ids", listed("cited_failure_ids"))


@query("coerce_confidence", f"SELECT failure_id, attempt, {_share} AS confidence FROM sh_objects")
def _(t):
    return replies.coerce_triage(objects_of(t), keep=("failure_id", "attempt")).select("failure_id", "attempt", "confidence")


@query("coerce_flake", f"SELECT failure_id, attempt, {_flake} AS is_likely_flake FROM sh_objects")
def _(t):
    return replies.coerce_triage(objects_of(t), keep=("failure_id", "attempt")).select("failure_id", "attempt", "is_likely_flake")


_prose = O.trim("text")


@query("fallback_triage", f"""
SELECT doc_id AS failure_id, CASE WHEN {_prose} <> '' THEN '{replies.UNPARSED_CAUSE}' || {O.clip(_prose, 1000)} ELSE '{replies.NO_OUTPUT}' END AS root_cause,
  '{replies.UNPARSED_FIX}' AS suggested_fix, cast(0.1 AS DOUBLE) AS confidence, source = 'oom' AS is_likely_flake, '' AS cited_failure_ids,
  {O.clip("coalesce(nullif(" + O.spaces('lang') + ", ''), 'Unparsed triage for ' || source)", 120)} AS headline FROM documents
""")
def _(t):
    docs = t.raw("documents").select(
        F.col("doc_id").alias("failure_id"), F.col("text").alias("reply"),
        F.col("source").alias("category"), F.col("lang").alias("signature_text"),
    )
    return replies.fallback_triage(docs).withColumn("cited_failure_ids", listed("cited_failure_ids"))


@query("first_valid_reply", """
SELECT failure_id, arg_min(json_extract_string(object, '$.rootCause'), attempt) FILTER (object IS NOT NULL AND json_extract_string(object, '$.rootCause') IS NOT NULL AND attempt = first) AS root_cause,
  max(first) AS attempt, arg_max(reply, attempt) AS last_reply FROM (
  SELECT *, min(attempt) FILTER (object IS NOT NULL) OVER (PARTITION BY failure_id) AS first FROM sh_reply_objects) GROUP BY failure_id
""")
def _(t):
    out = replies.first_valid_reply(t.replies)
    cause = F.try_variant_get(F.try_parse_json("object"), "$.rootCause", "string")
    return out.select("failure_id", cause.alias("root_cause"), "attempt", "last_reply")


catalog.SHARED["sh_chosen"] = """
SELECT c.failure_id, object, last_reply, category, signature_text, coalesce(json_extract_string(object, '$.rootCause'), json_extract_string(object, '$.analysis')) AS jc,
  json_extract_string(object, '$.headline') AS jh FROM (
  SELECT failure_id, arg_min(object, attempt) FILTER (object IS NOT NULL) AS object, arg_max(reply, attempt) AS last_reply FROM sh_reply_objects GROUP BY failure_id) c
JOIN fx_failures f ON f.id = c.failure_id
"""
_body = O.trim("regexp_replace(last_reply, '```(json)?', '', 'g')")
_fix = f"coalesce(nullif({O.trim('json_extract_string(object, ' + chr(39) + '$.suggestedFix' + chr(39) + ')')}, ''), '{replies.NO_FIX}')"


@query("triage_from_replies", f"""
SELECT failure_id, CASE WHEN object IS NOT NULL THEN {O.clip(_cause, 1200)} WHEN {_body} <> '' THEN '{replies.UNPARSED_CAUSE}' || {O.clip(_body, 1000)} ELSE '{replies.NO_OUTPUT}' END AS root_cause,
  CASE WHEN object IS NOT NULL THEN {O.clip(_fix, 2000)} ELSE '{replies.UNPARSED_FIX}' END AS suggested_fix,
  CASE WHEN object IS NOT NULL THEN {_share} ELSE 0.1 END AS confidence,
  CASE WHEN object IS NOT NULL THEN {_flake} ELSE category IN ('infra_timeout', 'network_error', 'oom') END AS is_likely_flake,
  CASE WHEN object IS NOT NULL THEN {_cited} ELSE '' END AS cited_failure_ids,
  CASE WHEN object IS NOT NULL THEN {O.clip(f"coalesce(nullif({O.trim('jh')}, ''), {_cause})", 120)} ELSE {O.clip(O.spaces('signature_text'), 120)} END AS headline
FROM sh_chosen
""")
def _(t):
    known = t.failures.select(
        F.col("id").alias("failure_id"), "category", "signature_text",
        F.array(*[F.lit(i) for i in ALLOWED]).alias("allowed"),
    )
    out = replies.triage_from_replies(t.replies, known)
    return out.withColumn("cited_failure_ids", listed("cited_failure_ids"))


_bare = "regexp_replace(text, '^[\"'']|[\"'']$', '', 'g')"


@query("clean_summaries", f"SELECT doc_id, {O.clip(O.spaces(_bare), 120)} AS summary FROM documents")
def _(t):
    return replies.clean_summaries(t.raw("documents")).select("doc_id", "summary")


@query("reassemble_answers", f"""
WITH tokens AS (SELECT stream_id, seq, CASE WHEN json_valid(p) THEN json_extract_string(p, '$.response') END AS tok FROM (
  SELECT *, CASE WHEN line LIKE 'data:%' THEN {O.trim('substring(line, 6)')} END AS p FROM fx_frames) WHERE p <> '' AND p <> '[DONE]')
SELECT s.stream_id, coalesce(answer, '{replies.NO_ANSWER}') AS answer FROM (SELECT DISTINCT stream_id FROM fx_frames) s
LEFT JOIN (SELECT stream_id, string_agg(tok, '' ORDER BY seq) AS answer FROM tokens WHERE tok <> '' GROUP BY 1) a ON a.stream_id = s.stream_id
""")
def _(t):
    return replies.reassemble_answers(t.frames)


# ---- context ----------------------------------------------------------------------
def memory_rows(t: Tables) -> DataFrame:
    near = neighbours_of(t, ("status", "signature_text", "last_seen_at", "root_cause"))
    return near.select(
        "*", F.lit(1).cast("long").alias("occurrence_count"), F.lit(None).cast("string").alias("resolution_note"),
        F.when(F.col("status") == "resolved", F.lit("  retry   it ")).alias("suggested_fix"),
    )


catalog.SHARED["sh_prior"] = f"""
SELECT query_id AS failure_id, '{context.PRIOR_OPEN}' || chr(10) || '{context.PRIOR_NOTE}' || chr(10) || string_agg(
  '--- id: ' || n.id || chr(10) || 'similarity: ' || printf('%.3f', score) || ' | status: ' || status || ' | seen: ' || {O.days_ago('last_seen_at', NOW)}
  || ' | occurrences: 1' || chr(10) || 'signature: ' || signature_text || chr(10) || 'root cause: cause of ' || n.id || chr(10)
  || 'fix that worked: ' || CASE WHEN status = 'resolved' THEN 'retry it' ELSE '(not recorded)' END, chr(10) ORDER BY rank)
  || chr(10) || '{context.PRIOR_CLOSE}' AS block
FROM sh_neighbours n JOIN fx_vectors v ON v.id = n.id WHERE rank <= 4 GROUP BY query_id
"""
_no_prior = f"'{context.PRIOR_OPEN}' || chr(10) || '{context.PRIOR_NONE}' || chr(10) || '{context.PRIOR_CLOSE}'"


@query("prior_blocks", f"SELECT v.id AS failure_id, coalesce(block, {_no_prior}) AS prior_block FROM fx_vectors v LEFT JOIN sh_prior p ON p.failure_id = v.id")
def _(t):
    targets = t.vectors.select(F.col("id").alias("failure_id"))
    return context.prior_blocks(targets, memory_rows(t), NOW)


_contexts = f"""
SELECT 'v-' || log_id AS failure_id, concat_ws(chr(10), '=== FAILING JOB ===', 'category: ' || category, 'parser confidence: ' || printf('%.2f', confidence),
  'implicated file/test: ' || coalesce(nullif(file_hint, ''), 'unknown'), '', 'normalised signature:', {O.cap('text', 600)}, '', 'log excerpt:', {O.cap('excerpt', 2000)}, '',
  coalesce(block, {_no_prior}), '', 'Return the JSON object now.') AS context FROM sh_signatures s LEFT JOIN sh_prior p ON p.failure_id = 'v-' || log_id
"""


@query("triage_contexts", _contexts)
def _(t):
    signed = fingerprint.fingerprint_logs(t.logs).withColumn("failure_id", F.concat(F.lit("v-"), "log_id"))
    blocks = context.prior_blocks(t.logs.select(F.concat(F.lit("v-"), "log_id").alias("failure_id")), memory_rows(t), NOW)
    return context.triage_contexts(signed, blocks)


@query("triage_messages", f"""
WITH c AS ({_contexts}), m AS (SELECT failure_id, 0 AS position, 'system' AS role, '{context.TRIAGE_RULES}' AS content FROM c
  UNION ALL SELECT failure_id, 1, 'user', context FROM c)
SELECT failure_id, position, role, content FROM m
""")
def _(t):
    signed = fingerprint.fingerprint_logs(t.logs).withColumn("failure_id", F.concat(F.lit("v-"), "log_id"))
    blocks = context.prior_blocks(t.logs.select(F.concat(F.lit("v-"), "log_id").alias("failure_id")), memory_rows(t), NOW)
    return context.triage_messages(context.triage_contexts(signed, blocks))


catalog.SHARED["sh_recent"] = f"""
SELECT repo, 'RECENT FAILURES (newest first):' || chr(10) || string_agg('  - id=' || id || ' | ' || status || ' | ' || category || ' | '
  || coalesce(nullif(branch, ''), 'unknown-branch') || ' | ' || {O.days_ago('last_seen_at', NOW)} || ' | x' || occurrence_count || ' | '
  || {O.one_line('signature_text', 160)}, chr(10) ORDER BY rank) AS recent FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY last_seen_at DESC, id) AS rank FROM fx_failures) WHERE rank <= 8 GROUP BY repo
"""
catalog.SHARED["sh_contexts"] = f"""
SELECT r.repo, concat_ws(chr(10), 'repo: ' || r.repo, 'window: last 7 days', 'open failures: ' || coalesce(open_count, 0),
  'resolved failures: ' || coalesce(resolved_count, 0), '', '{context.FLAKES_TITLE}', coalesce(flakes, '  (none)'), '', recent) AS context
FROM sh_recent r LEFT JOIN sh_counts c ON c.repo = r.repo LEFT JOIN (
  SELECT repo, string_agg('  - ' || count || 'x [' || substring(signature_hash, 1, 8) || '] ' || {O.one_line('signature_text', 160)}, chr(10) ORDER BY rank) AS flakes
  FROM sh_flakes WHERE rank <= 6 GROUP BY repo) f ON f.repo = r.repo
"""


@query("repo_contexts", "SELECT * FROM sh_contexts")
def _(t):
    return context.repo_contexts(t.failures, NOW)


@query("chat_messages", f"""
WITH q AS (SELECT DISTINCT repo FROM fx_messages), turns AS (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY id) AS position FROM (SELECT * FROM fx_messages QUALIFY {_history} <= 6))
SELECT repo, 0 AS position, 'system' AS role, 'CI assistant, answering for the repository ' || repo
  || '. Use only the facts between the context markers and say what is missing.' AS content FROM q
UNION ALL SELECT repo, position, CASE WHEN role = 'assistant' THEN role ELSE 'user' END, {O.one_line('content', 500)} FROM turns WHERE {O.spaces('content')} <> ''
UNION ALL SELECT q.repo, 7, 'user', concat_ws(chr(10), '=== CONTEXT ===', coalesce(context, 'RECENT FAILURES:' || chr(10) || '  (none recorded)'),
  '=== END CONTEXT ===', '', 'Question: What is flaky in ' || q.repo || '?') FROM q LEFT JOIN sh_contexts c ON c.repo = q.repo
""")
def _(t):
    asked = t.messages.select("repo").distinct().withColumn(
        "question", F.concat(F.lit(" What is  flaky in "), "repo", F.lit("?"))
    )
    return context.chat_messages(asked, context.repo_contexts(t.failures, NOW), t.messages)


@query("summary_inputs", f"SELECT doc_id, coalesce(nullif({O.cap('text', 1200)}, ''), '(empty log)') AS summary_input FROM documents")
def _(t):
    return context.summary_inputs(t.raw("documents"), "text").select("doc_id", "summary_input")


# ---- dashboard -----------------------------------------------------------------------
_detail = "(SELECT *, cast(trim(detail) AS JSON) AS d FROM fx_runs WHERE trim(detail) LIKE '{%' AND json_valid(trim(detail)))"


@query("merged_triage", f"""
SELECT f.id, coalesce(f.root_cause, nullif(r.root_cause, '')) AS root_cause, coalesce(f.suggested_fix, nullif(r.suggested_fix, '')) AS suggested_fix,
  coalesce(f.confidence, r.confidence) AS confidence, f.is_likely_flake,
  array_to_string(list_filter(cited_failure_ids, lambda x: x <> '' AND x <> f.id)[1:8], ',') AS cited_failure_ids,
  coalesce(f.headline, CASE WHEN json_type(r.headline) = 'VARCHAR' THEN nullif(json_extract_string(r.headline, '$'), '') END) AS headline
FROM sh_failures f LEFT JOIN (
  SELECT failure_id, arg_min(json_extract_string(d, '$.rootCause'), (created_at, id)) FILTER (json_type(d, '$.rootCause') <> 'NULL') AS root_cause,
    arg_min(json_extract_string(d, '$.suggestedFix'), (created_at, id)) FILTER (json_type(d, '$.suggestedFix') <> 'NULL') AS suggested_fix,
    arg_min(cast(json_extract_string(d, '$.confidence') AS DOUBLE), (created_at, id)) FILTER (json_type(d, '$.confidence') <> 'NULL') AS confidence,
    arg_min(json_extract(d, '$.headline'), (created_at, id)) FILTER (json_type(d, '$.headline') <> 'NULL') AS headline
  FROM {_detail} GROUP BY failure_id) r ON r.failure_id = f.id
""")
def _(t):
    out = dashboard.merged_triage(failures_of(t), t.runs)
    return out.withColumn("cited_failure_ids", listed("cited_failure_ids"))


@query("feed_summary", """
SELECT repo, count(*) AS total, count(*) FILTER (status = 'awaiting_approval') AS awaiting, count(*) FILTER (occurrence_count > 2) AS hot FROM fx_failures GROUP BY repo
""")
def _(t):
    return dashboard.feed_summary(t.failures)


@query("next_actions", """
SELECT id, CASE WHEN status = 'awaiting_approval' THEN 'approve' WHEN status = 'triaged' OR status = 'open' AND root_cause <> '' THEN 'resolve' END AS next_action FROM fx_failures
""")
def _(t):
    return dashboard.next_actions(t.failures).select("id", "next_action")


@query("confidence_bands", """
SELECT id, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.45 THEN 'mid' WHEN confidence IS NOT NULL THEN 'low' END AS band FROM fx_failures
""")
def _(t):
    return dashboard.confidence_bands(t.failures).select("id", "band")


def _cases(column: str, labels: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + f" ELSE coalesce(nullif({column}, ''), 'unknown') END"


@query("labelled_failures", f"""
SELECT id, {_cases('category', dashboard.CATEGORY_LABELS)} AS category_label, {_cases('status', dashboard.STATUS_LABELS)} AS status_label FROM fx_failures
UNION ALL SELECT id, {_cases('branch', dashboard.CATEGORY_LABELS)}, {_cases('commit_sha', dashboard.STATUS_LABELS)} FROM fx_failures
""")
def _(t):
    odd = t.failures.select("id", F.col("branch").alias("category"), F.col("commit_sha").alias("status"))
    both = t.failures.select("id", "category", "status").unionByName(odd)
    return dashboard.labelled_failures(both).select("id", "category_label", "status_label")


@query("repo_picker", "SELECT DISTINCT repo FROM (SELECT repo FROM fx_failures UNION ALL SELECT repo FROM fx_messages)")
def _(t):
    return dashboard.repo_picker(t.failures, t.messages)


# ---- transcripts ----------------------------------------------------------------------
catalog.SHARED["sh_rows"] = f"SELECT session, line_no, cast(line AS JSON) AS r FROM fx_transcripts WHERE {O.trim('line')} <> '' AND json_valid(line)"
catalog.SHARED["sh_typed"] = """
SELECT session, line_no, CASE WHEN json_type(r, '$.message.content') = 'VARCHAR' THEN json_extract_string(r, '$.message.content')
  WHEN json_type(r, '$.message.content') = 'ARRAY' THEN array_to_string(list_transform(list_filter(cast(json_extract(r, '$.message.content[*]') AS JSON[]),
    lambda b: json_extract_string(b, '$.type') = 'text'), lambda b: json_extract_string(b, '$.text')), chr(10)) END AS text
FROM sh_rows WHERE json_extract_string(r, '$.type') = 'user'
"""
_skip = " AND ".join(f"NOT starts_with({O.trim('text')}, '{p}')" for p in transcripts.P.SKIPPED_PROMPT_PREFIXES)
catalog.SHARED["sh_human"] = f"SELECT session, line_no, {O.trim('text')} AS text FROM sh_typed WHERE {O.trim('text')} <> '' AND {_skip}"
catalog.SHARED["sh_briefs"] = """
SELECT session, line_no, position, coalesce(json_extract_string(b, '$.input.description'), 'agent') AS label, json_extract_string(b, '$.input.prompt') AS text FROM (
  SELECT session, line_no, unnest(l) AS b, generate_subscripts(l, 1) - 1 AS position FROM (
    SELECT session, line_no, list_filter(cast(json_extract(r, '$.message.content[*]') AS JSON[]), lambda b: json_extract_string(b, '$.type') = 'tool_use'
      AND json_extract_string(b, '$.name') = 'Agent' AND json_extract_string(b, '$.input.prompt') <> '') AS l
    FROM sh_rows WHERE json_extract_string(r, '$.type') = 'assistant' AND json_type(r, '$.message.content') = 'ARRAY'))
"""


def redact_sql(x: str) -> str:
    for pattern, to in transcripts.P.REDACTIONS:
        x = f"regexp_replace({x}, {O.quote(pattern)}, {O.quote(to.replace('$', chr(92)))}, 'g')"
    return x


@query("scan_transcripts", "SELECT session, line_no, json_extract_string(r, '$.type') AS type FROM sh_rows")
def _(t):
    rows = transcripts.scan_transcripts(t.transcripts)
    return rows.select("session", "line_no", V.as_string(V.at(F.col("row"), "type")).alias("type"))


@query("human_prompts", "SELECT session, line_no, text FROM sh_human")
def _(t):
    return transcripts.human_prompts(transcripts.scan_transcripts(t.transcripts))


@query("agent_briefs", "SELECT session, line_no, position, label, text FROM sh_briefs")
def _(t):
    return transcripts.agent_briefs(transcripts.scan_transcripts(t.transcripts))


@query("redact_text", f"SELECT doc_id, {redact_sql('text')} AS text FROM documents")
def _(t):
    return transcripts.redact_text(t.raw("documents")).select("doc_id", "text")


@query("export_prompts", f"""
SELECT number, kind, '## ' || number || '. ' || CASE WHEN kind = 'human' THEN 'Developer prompt' ELSE 'Sub-agent brief — ' || label END AS heading, {redact_sql('text')} AS text FROM (
  SELECT *, row_number() OVER (ORDER BY session, line_no, position) AS number FROM (
    SELECT session, line_no, -1 AS position, 'human' AS kind, NULL AS label, text FROM sh_human
    UNION ALL SELECT session, line_no, position, 'agent', label, text FROM sh_briefs))
""")
def _(t):
    return transcripts.export_prompts(t.transcripts)


@query("prompt_totals", """
SELECT (SELECT count(*) FROM sh_human) + (SELECT count(*) FROM sh_briefs) AS recorded, (SELECT count(*) FROM sh_human) AS human, (SELECT count(*) FROM sh_briefs) AS agent
""")
def _(t):
    return transcripts.prompt_totals(t.transcripts)
