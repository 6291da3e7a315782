import hashlib
import hmac
import json
import random
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.functions import variants as V
from faultline.functions import vectors as X
from faultline.functions.ordering import with_row_numbers
from faultline.operators import failures, ingest, replies, stats, transcripts, triage, vectors
from faultline.sources import tables

NOW = 1_700_000_000_000
HOUR, DAY = S.HOUR_MS, S.DAY_MS


# ---- the demo corpus: id, repo, hash, category, status, occurrences, age -------------
# fixed values: the seed corpus
SEED = [
    ("seed-wa-001", "acme/web-app", "c3a91e77", "test_failure", "resolved", 9, 4 * DAY),
    ("seed-wa-002", "acme/web-app", "c3a91e77", "test_failure", "triaged", 6, 9 * HOUR),
    ("seed-wa-003", "acme/web-app", "5e2b8daf", "oom", "resolved", 4, 12 * DAY),
    ("seed-wa-004", "acme/web-app", "ab40c1d9", "compile_error", "resolved", 1, 23 * DAY),
    ("seed-wa-005", "acme/web-app", "1c7fd3e0", "lint_error", "open", 2, 30 * HOUR),
    ("seed-ag-001", "acme/api-gateway", "9d61f0a4", "dependency_error", "resolved", 5, 14 * DAY),
    ("seed-ag-002", "acme/api-gateway", "9d61f0a4", "dependency_error", "awaiting_approval", 3, 5 * HOUR),
    ("seed-ag-003", "acme/api-gateway", "4f08ca19", "network_error", "resolved", 7, 31 * DAY),
    ("seed-ag-004", "acme/api-gateway", "6b1e94dc", "test_failure", "open", 1, 20 * HOUR),
    ("seed-ag-005", "acme/api-gateway", "e70c2b85", "permission_error", "resolved", 2, 26 * DAY),
    ("seed-dp-001", "acme/data-pipeline", "2fb7c905", "infra_timeout", "resolved", 11, 9 * DAY),
    ("seed-dp-002", "acme/data-pipeline", "2fb7c905", "infra_timeout", "open", 4, 14 * HOUR),
    ("seed-dp-003", "acme/data-pipeline", "d51a03c6", "test_failure", "resolved", 1, 18 * DAY),
    ("seed-dp-004", "acme/data-pipeline", "83c4e0f1", "dependency_error", "open", 3, 2 * HOUR),
]


def corpus(spark):
    rows = [
        (i, repo, "main", "github", "1", "job", None, None, h, f"text of {h}", cat, None, "log",
         [0.0] * S.EMBEDDING_DIMS, 1.0, status, None, None, None, None, False,
         ["seed-wa-001"] if i == "seed-wa-002" else [], None, None, n, NOW - age, NOW - age)
        for i, repo, h, cat, status, n, age in SEED
    ]
    return spark.createDataFrame(rows, S.FAILURES)


def test_demo_corpus_reports(spark):
    df = corpus(spark)
    assert [r.repo.split("/")[1] for r in failures.list_repos(df).collect()] == ["data-pipeline", "api-gateway", "web-app"]

    def counts(days):
        return {r.repo.split("/")[1]: (r.open_count, r.resolved_count) for r in stats.repo_counts(df, NOW, days).collect()}

    assert counts(7) == {"web-app": (2, 1), "api-gateway": (2, 0), "data-pipeline": (2, 0)}
    assert counts(30) == {"web-app": (2, 3), "api-gateway": (2, 2), "data-pipeline": (2, 2)}

    def flakes(days):
        return {(r.repo.split("/")[1], r.signature_hash): r["count"] for r in stats.top_flakes(df, NOW, days).collect()}

    assert flakes(7) == {
        ("web-app", "c3a91e77"): 15, ("api-gateway", "9d61f0a4"): 3,
        ("data-pipeline", "2fb7c905"): 4, ("data-pipeline", "83c4e0f1"): 3,
    }
    assert flakes(30) == {
        ("web-app", "c3a91e77"): 15, ("web-app", "5e2b8daf"): 4, ("api-gateway", "9d61f0a4"): 8,
        ("data-pipeline", "2fb7c905"): 15, ("data-pipeline", "83c4e0f1"): 3,
    }
    memory = df.withColumnRenamed("embedding", "vector")
    assert vectors.missing_embeddings(memory, 200).count() == 14
    asked = memory.select(F.col("id").alias("query_id"), "repo", "vector")
    assert vectors.search_similar(asked, memory).count() == 0
    cited = failures.cited_failures(df, df).collect()
    assert [(r.failure_id, r.cited_id) for r in cited] == [("seed-wa-002", "seed-wa-001")]


def test_snapshot_upsert_and_reads(spark, scratch):
    df = corpus(spark)
    first = tables.write_failures(df, scratch)
    again = df.limit(2).withColumn("last_seen_at", F.lit(NOW)).withColumn("repo", F.lit("other")).withColumn("seq", F.lit(1))
    fresh = df.limit(1).withColumn("id", F.lit("new-1")).withColumn("seq", F.lit(2))
    second = tables.upsert_into(spark, first, again.unionByName(fresh), scratch)
    assert tables.read_failures(spark, first).count() == 14
    rows = {r.id: r for r in tables.read_failures(spark, second).collect()}
    assert len(rows) == 15
    changed = [r.id for r in again.collect()]
    assert all(rows[i].last_seen_at == NOW and rows[i].repo != "other" for i in changed)
    plan = failures.get_failure(tables.read_failures(spark, second), "x")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,x)" in plan and "embedding" not in plan


def test_audit_outbox_and_report(spark, scratch):
    steps = spark.createDataFrame(
        [("f", "w", "analyse", "ok", "x" * 3000, 5, NOW)],
        "failure_id string, workflow_id string, step string, status string, detail string, duration_ms long, created_at long",
    )
    tables.append_runs(steps, f"{scratch}/runs")
    tables.append_runs(steps, f"{scratch}/runs")
    rows = tables.read_runs(spark, f"{scratch}/runs").collect()
    assert len({r.id for r in rows}) == 2 and {len(r.detail) for r in rows} == {2000}
    results = spark.createDataFrame(
        [("a", "http://x", "h", "c", "f", 0.876), ("b", None, "h", "c", "f", 0.5)],
        "id string, run_url string, headline string, root_cause string, suggested_fix string, confidence double",
    )
    tables.write_outbox(triage.postback_outbox(results, True), f"{scratch}/outbox")
    out = {r.id: r for r in spark.read.parquet(f"{scratch}/outbox").collect()}
    assert out["a"].reason == "ready" and "confidence 88%" in out["a"].body
    assert out["b"].reason == "no_run_url"
    lines = [
        {"type": "user", "message": {"content": "first prompt Bearer abcdefghijklmnopqrstuvwxyz"}},
        {"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "Agent", "input": {"prompt": "look"}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "content": "x"}]}},
    ]
    path = f"{scratch}/session.jsonl"
    with open(path, "w") as f:
        f.write("\n".join(json.dumps(x) for x in lines) + "\n\nnot json\n")
    report = transcripts.export_prompts(tables.read_transcripts(spark, path))
    tables.write_prompt_report(report, f"{scratch}/report")
    text = "\n".join(r.value for r in spark.read.text(f"{scratch}/report").collect())
    assert "## 1. Developer prompt" in text and "## 2. Sub-agent brief — agent" in text
    assert "Bearer <redacted>" in text and "abcdefghij" not in text


# ---- vectors ---------------------------------------------------------------------------
def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    dims, n = 16, 600
    base = rng.normal(size=(n, dims))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    base = base.astype("float32")
    repo = ["hot" if i % 3 else "cold" for i in range(n)]
    status = [["resolved", "open", "dismissed"][i % 3 if i % 2 else 0] for i in range(n)]
    rows = [(f"v{i:04d}", repo[i], status[i], i, f"t{i}", base[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, repo string, status string, last_seen_at long, signature_text string, vector array<float>")
    asked = df.select(F.col("id").alias("query_id"), "repo", "vector")
    got = {}
    for r in vectors.search_similar(asked, df, k=4, min_score=0.3, dims=dims).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    for i in range(n):
        pool = []
        for bucket, limit in (("resolved", 192), ("open", 64)):
            mine = [j for j in range(n) if repo[j] == repo[i] and status[j] == bucket]
            pool += sorted(mine, key=lambda j: -j)[:limit]
        scored = [(j, float(np.dot(base[i].astype("float64"), base[j].astype("float64")))) for j in pool if j != i]
        best = sorted([(j, s) for j, s in scored if s >= 0.3], key=lambda x: -x[1])[:4]
        assert [f"v{j:04d}" for j, _ in best] == [got.get(f"v{i:04d}", {}).get(k + 1) for k in range(len(best))]
        assert len(got.get(f"v{i:04d}", {})) == len(best)


def test_normalise_and_codec(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 2.0]), (4, [float("inf"), 0.0]), (5, [1e-30, 0.0])]
    df = spark.createDataFrame(rows, "id int, vector array<double>")
    got = {r.id: r.vector for r in df.select("id", X.normalise("vector").alias("vector")).collect()}
    assert np.allclose(got[1], [0.6, 0.8]) and got[2] == [0, 0] and got[3] == [0, 1] and got[4] == [0, 0]
    assert np.allclose(got[5], [1, 0])
    coded = vectors.encode_vectors(df, 4)
    blobs = {r.id: r.blob for r in coded.collect()}
    assert np.allclose(np.frombuffer(blobs[1], "<f4"), [0.6, 0.8, 0, 0]) and len(blobs[2]) == 16
    back = {r.id: r.decoded for r in vectors.decode_vectors(coded.select("id", "blob"), 4).collect()}
    assert np.allclose(back[1], [0.6, 0.8, 0, 0])
    assert vectors.decode_vectors(coded.select("id", "blob"), 5).first().decoded is None


def test_vector_sources(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b a a"), (3, "  "), (4, "other words")], "id int, signature_text string")
    own = {r.id: r.vector for r in vectors.embed_texts(df, dims=32).collect()}
    assert own[1] == own[2] != own[4] and 3 not in own
    assert abs(sum(x * x for x in own[1]) - 1) < 1e-6
    given = vectors.embed_texts(df, dims=2, embedder=lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert {r.id: len(r.vector) for r in given.collect()} == {1: 2, 2: 2, 4: 2}


# ---- ingest ------------------------------------------------------------------------------
def deliveries(spark, bodies, headers=None):
    rows = [(str(i), 1000 + i, headers[i] if headers else {}, b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "delivery_id string, received_at long, headers map<string,string>, raw_body string")


def test_signatures_match_hmac(spark):
    for secret in ("short", "k" * 100):
        bodies = ["{}", "päyload ✖", "x" * 5000]
        digest = [hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest() for b in bodies]
        heads = [{"X-Hub-Signature-256": "sha256=" + digest[0]}, {"x-webhook-signature": digest[1].upper()}, {"x-signature-256": digest[0]}]
        df = ingest.verify_deliveries(deliveries(spark, bodies, heads), secret)
        assert [r.verified for r in df.orderBy("delivery_id").collect()] == [True, True, False]
    assert ingest.verify_deliveries(deliveries(spark, ["{}"]), None).first().verified


def test_values_keep_their_json_type(spark):
    bodies = [
        json.dumps({"repo": True, "project": 12, "log": "true"}),
        json.dumps({"repo": {"a": 1}, "repoName": " r ", "log": "[not json", "timestamp": 1700000000}),
        json.dumps({"repo": "r", "logs": ["x"], "text": "t", "occurredAt": "2024-01-01", "user": 1.50}),
        json.dumps({"repo": "r", "log": "  "}),
    ]
    rows = {r.delivery_id: r for r in ingest.adapt(deliveries(spark, bodies), "manual").collect()}
    assert rows["0"].repo == "12" and rows["0"].log_text == "true"
    assert rows["1"].repo == "r" and rows["1"].log_text == "[not json" and rows["1"].occurred_at == 1700000000000
    assert rows["2"].log_text == "t" and rows["2"].occurred_at == 1704067200000 and rows["2"].author == "1.5"
    assert "3" not in rows


def test_outcomes(spark):
    ok = {"workflow_run": {"id": 1, "status": "completed", "conclusion": "failure"}, "repository": {"full_name": "a/b"}}
    bodies = [
        json.dumps(ok), json.dumps({**ok, "workflow_run": {"status": "completed", "conclusion": "cancelled"}}),
        "[1]", "nope", "", json.dumps({"repo": "a/b", "log": "x" * 50, "requireApproval": True}), json.dumps({"repo": "r", "log": "x" * 1_000_001}),
    ]
    rows = {r.delivery_id: r for r in ingest.normalise_deliveries(deliveries(spark, bodies)).collect()}
    assert [rows[str(i)].outcome for i in range(7)] == ["accepted", "ignored", "rejected", "rejected", "rejected", "accepted", "rejected"]
    assert rows["0"].log_text.startswith('GitHub Actions workflow_run "workflow" concluded: failure.')
    assert rows["0"].occurred_at == 1000 and not rows["0"].require_approval and rows["5"].require_approval
    assert rows["6"].reason == "body is too long"


# ---- replies -------------------------------------------------------------------------------
def spans_by_decoder(text):
    """Brace spans by a character walk."""
    out, i = [], 0
    while True:
        start = text.find("{", i)
        if start < 0:
            return out
        depth, quoted, skip, end = 0, False, False, None
        for p in range(start, len(text)):
            c = text[p]
            if skip:
                skip = False
            elif c == "\\":
                skip = quoted
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    end = p + 1
                    break
        if end is None:
            return out
        out.append(text[start:end])
        i = end


def test_balanced_spans(spark):
    """The scan equals a walk over the characters, on short texts of all kinds and on long ones."""
    rng = random.Random(5)
    texts = {"".join(rng.choice('{}{}"\\ab \n') for _ in range(rng.randrange(25))) for _ in range(6000)}
    texts |= {"".join(rng.choice('{}"\\é\U0001f600') for _ in range(3000)) for _ in range(5)}
    texts |= {"x" * 50_000 + '{"a": "' + "}" * 20_000 + '"} ' * 3 + "{}" * 500}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", replies.balanced("t").alias("spans"))
    for r in df.collect():
        assert r.spans == spans_by_decoder(r.t), repr(r.t[:200])


def test_reply_objects(spark):
    good = '{"rootCause": "a } b", "confidence": 0.5}'
    texts = [
        good, f"```json\n{good}\n```", f"Sure: {good} done", f'{{"x": 1}} then {good}', '{"x": 1} and {"y": 2}',
        "no object", "", '{"rootCause": "cut', "```\n" + good, "[1, 2]",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, reply string")
    got = {r.i: r.object for r in replies.extract_reply_json(df).collect()}
    assert [got[i] for i in range(10)] == [good, good, good, good, '{"x": 1}', None, None, None, good, None]


def test_confidence_words(spark):
    values = ["0.8", "85", '"70%"', '"0.4 or so"', '"x"', "null", "-3", "250", "true", '"1e-1"']
    df = spark.createDataFrame([(i, '{"confidence": %s}' % v) for i, v in enumerate(values)], "failure_id int, object string")
    df = df.withColumn("category", F.lit("oom")).withColumn("allowed", F.array(F.lit("a")))
    got = {r.failure_id: r for r in replies.coerce_triage(df).collect()}
    assert [got[i].confidence for i in range(10)] == [0.8, 0.85, 0.7, 0.4, 0.5, 0.5, 0.0, 1.0, 0.5, 0.1]
    assert got[0].is_likely_flake and got[0].root_cause == replies.NO_CAUSE


# ---- ordering, approvals -----------------------------------------------------------------------
def test_row_numbers_under_skew(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id") % 50).alias("a"), F.col("id").alias("b"))
    rows = with_row_numbers(df.repartition(7), ["a", "b"]).collect()
    ranked = sorted(rows, key=lambda r: (r.a, r.b))
    assert [r.number for r in ranked] == list(range(1, 5001))


def test_many_decisions_for_one_failure(spark):
    approvals = spark.range(2000).select(
        F.lit("hot").alias("failure_id"), (F.col("id") == 1500).alias("approved"), F.lit(None).cast("string").alias("edited_fix"),
        F.lit("r").alias("reviewer"), (F.lit(NOW) + (F.col("id") - 1500) * 1000).alias("ts"), F.col("id").alias("event_id"),
    )
    pending = spark.createDataFrame([("hot", NOW, "new", True), ("cold", NOW, "new", True)], "failure_id string, pending_at long, verdict string, require_approval boolean")
    got = {r.failure_id: r.approval for r in triage.triage_outcomes(pending, approvals).collect()}
    assert got == {"hot": "approved", "cold": "timed_out"}


def utc(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1000)


AT = utc(2026, 2, 17, 11, 4, 28)
DATES = {
    "Tue, 17 Feb 2026 11:04:28 GMT": AT, "17 Feb 2026 11:04:28 +0100": AT - S.HOUR_MS,
    "Tue Feb 17 2026 11:04:28 GMT+0000 (Coordinated Universal Time)": AT, "Feb 17, 2026 11:04:28 PM": AT + 12 * S.HOUR_MS,
    "February 17, 2026": utc(2026, 2, 17), "2026/02/17 11:04:28": AT, "2/17/2026 11:04": utc(2026, 2, 17, 11, 4),
    "2/17/2026, 12:04:28 AM": utc(2026, 2, 17, 0, 4, 28), "17-Feb-2026 11:04:28 PST": AT + 8 * S.HOUR_MS,
    "2026/2/7 1:02:03.25 -0530": utc(2026, 2, 7, 6, 32, 3) + 250, "Sept 5, 2026": utc(2026, 9, 5),
    "2026-02-17T11:04:28Z": AT, "2026-02-17 11:04:28 UTC": AT, "2026-02-17": utc(2026, 2, 17),
    "2026-02-17T11:04:28.5+02:00": AT - 2 * S.HOUR_MS + 500, "1771326268": 1771326268000, " 1771326268000 ": 1771326268000,
    "17 Feb 2026 25:00:00": None, "Foo 17 2026": None, "31 Feb 2026": None, "17 Feb 2026 11:04:28 XYZ": None,
    "13/13/2026": None, "2/17/2026 0:04 AM": None, "soon": None, "": None, None: None,
}


def test_dates_of_many_shapes(spark):
    df = spark.createDataFrame([(t,) for t in DATES], "t string").select("t", V.text_millis(F.col("t")).alias("ms"))
    assert {r.t: r.ms for r in df.collect()} == DATES


def test_search_of_odd_vectors(spark):
    """Ties, repeated ids, other lengths, numbers that are none, and a hot repository in many blocks."""
    inf, nan = float("inf"), float("nan")
    memory = [
        ("a", "r", "resolved", 3, [1.0, 0.0]), ("b", "r", "resolved", 2, [1.0, 0.0]), ("c", "r", "open", 9, [1.0, 0.0]),
        ("d", "r", "open", 8, [nan, 1.0]), ("e", "r", "open", 7, [1.0]), ("f", None, "open", 7, [1.0, 0.0]), ("g", "s", "dismissed", 1, [1.0, 0.0]),
    ]
    asked = [("a", "r", [1.0, 0.0, 5.0]), ("x", "r", [0.9]), ("y", "r", [inf, 0.0]), ("z", "r", None), ("w", "s", [1.0, 0.0]), ("v", None, [1.0, 0.0])]
    asked += [(f"h{i}", "r", [0.8, 0.0]) for i in range(20)]
    m = spark.createDataFrame(memory, "id string, repo string, status string, last_seen_at long, vector array<float>")
    q = spark.createDataFrame(asked, "query_id string, repo string, vector array<float>")
    before, vectors.QUERY_BLOCK = vectors.QUERY_BLOCK, 3
    try:
        rows = vectors.search_similar(q, m, k=2, min_score=0.5, dims=2, hydrate=("status", "last_seen_at")).collect()
    finally:
        vectors.QUERY_BLOCK = before
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.score, 6), r.status, r.last_seen_at))
    assert got.pop("a") == [(1, "b", 1.0, "resolved", 2), (2, "c", 1.0, "open", 9)]
    assert got.pop("x") == [(1, "a", 0.9, "resolved", 3), (2, "b", 0.9, "resolved", 2)]
    assert len(got) == 20 and all(v == [(1, "a", 0.8, "resolved", 3), (2, "b", 0.8, "resolved", 2)] for v in got.values())
