"""CI tables derived from the generic test tables.

The test data holds no CI records, so each CI table is a projection of one
generic table. A projection is written once, as SQL expressions, and rendered
for Spark and for the checking database, which differ in a few functions only.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources.tables import spread

NOW_MS = 1_706_659_200_000  # 2024-01-31T00:00:00Z
SECRET = "views-secret"
NL = "chr(10)"


class SparkDialect:
    @staticmethod
    def sha(x):
        return f"sha2({x}, 256)"

    @staticmethod
    def millis(ts):
        return (
            f"(datediff(cast({ts} AS DATE), DATE'1970-01-01') * 86400000L + hour({ts}) * 3600000L"
            f" + minute({ts}) * 60000L + cast(extract(SECOND FROM {ts}) * 1000 AS BIGINT))"
        )

    @staticmethod
    def json_long(x, key):
        return f"cast(get_json_object({x}, '$.{key}') AS BIGINT)"

    @staticmethod
    def json_quote(x):
        body = f"to_json(named_struct('v', {x}))"
        return f"substr({body}, 6, length({body}) - 6)"

    @staticmethod
    def headers(pairs):
        return "map(" + ", ".join(f"{k}, {v}" for k, v in pairs) + ")"

    @staticmethod
    def array(items, kind="STRING"):
        return "array(" + ", ".join(items) + ")" if items else f"cast(array() AS ARRAY<{kind}>)"

    @staticmethod
    def hmac(body, inner, outer):
        return (
            f"sha2(concat(unhex('{outer}'), unhex(sha2(concat(unhex('{inner}'),"
            f" cast({body} AS BINARY)), 256))), 256)"
        )

    @staticmethod
    def vector_zeros(x):
        return f"transform({x}, v -> cast(0 AS FLOAT))"

    @staticmethod
    def expand(n):
        return f"explode(sequence(0, {n - 1}))"


class DuckDialect:
    @staticmethod
    def sha(x):
        return f"sha256({x})"

    @staticmethod
    def millis(ts):
        return f"(epoch_us({ts}) // 1000)"

    @staticmethod
    def json_long(x, key):
        return f"cast(json_extract_string({x}, '$.{key}') AS BIGINT)"

    @staticmethod
    def json_quote(x):
        return f"cast(to_json({x}) AS VARCHAR)"

    @staticmethod
    def headers(pairs):
        return "MAP {" + ", ".join(f"{k}: {v}" for k, v in pairs) + "}"

    @staticmethod
    def array(items, kind="VARCHAR"):
        return "[" + ", ".join(items) + "]" if items else f"cast([] AS {kind}[])"

    @staticmethod
    def hmac(body, inner, outer):
        return (
            f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({body}))))"
        )

    @staticmethod
    def vector_zeros(x):
        return f"list_transform({x}, lambda v: cast(0 AS FLOAT))"

    @staticmethod
    def expand(n):
        return f"unnest(range(0, {n}))"


def pick(index, values, quote=True):
    """CASE over a small number: the fixed list of values by position."""
    arms = " ".join(
        f"WHEN {i} THEN " + (f"'{v}'" if quote and v is not None else "NULL" if v is None else str(v))
        for i, v in enumerate(values)
    )
    return f"CASE {index} {arms} END"


def text(*parts):
    """Concatenation; a str in quotes is literal, other parts are cast to text."""
    return "(" + " || ".join(p if p.startswith(("'", "chr(")) else f"cast({p} AS STRING)" for p in parts) + ")"


def lines(*rows):
    return "(" + f" || {NL} || ".join(rows) + ")"


def pads(secret: str):
    """Hex inner and outer HMAC-SHA256 pads of a secret."""
    import hashlib

    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


CATEGORY_BY_NUMBER = [
    "test_failure", "compile_error", "dependency_error", "infra_timeout", "oom",
    "lint_error", "permission_error", "network_error", "unknown",
]


def base_step(d):
    return [
        ("eid", "event_id"),
        ("uid", "user_id"),
        ("et", "event_type"),
        ("k", d.json_long("props", "k")),
        ("at_ms", d.millis("ts")),
        ("m", "user_id % 8"),
    ]


def failure_steps(d):
    return [
        base_step(d),
        [
            ("id", text("'f-'", "eid")),
            ("repo", text("'acme/repo-'", "uid % 20")),
            ("branch", pick("eid % 4", ["main", "dev", "feat/x", ""])),
            ("provider", pick("eid % 4", ["github", "jenkins", "gitlab", "manual"])),
            ("pipeline_id", text("eid")),
            ("job_name", text("'job-'", "uid % 5")),
            ("run_url", f"CASE WHEN eid % 3 = 0 THEN NULL ELSE {text(repr('https://ci.example.test/runs/'), 'eid')} END"),
            ("commit_sha", f"substr({d.sha(text(repr('c'), 'eid'))}, 1, 7)"),
            ("category", pick("uid % 9", CATEGORY_BY_NUMBER)),
            ("signature_text", text("et", "' failed in  module '", "m", NL, "'see step '", "uid % 3")),
            ("status", pick("eid % 5", ["open", "awaiting_approval", "triaged", "resolved", "dismissed"])),
            ("signature_confidence", f"cast({pick('eid % 3', ['1.0', '0.85', '0.2'], False)} AS DOUBLE)"),
            ("occurrence_count", "k % 5 + 1"),
            ("last_seen_at", "at_ms"),
            ("created_at", "at_ms - k * 3600000"),
            ("is_likely_flake", "uid % 3 = 0"),
            ("file_hint", f"CASE WHEN eid % 2 = 0 THEN {text(repr('src/mod'), 'm', repr('.ts'))} END"),
            ("excerpt", lines(text("'step '", "k", "' of '", "uid"), text("et", "' went wrong'"), "'  end of log  '")),
        ],
        [
            ("signature_hash", f"substr({d.sha('category || ' + NL + ' || signature_text')}, 1, 32)"),
            ("no_result", "status = 'open' AND eid % 2 = 0"),
            (
                "cited_text",
                "CASE eid % 7 WHEN 0 THEN 'oops' WHEN 1 THEN " + text("'[1, \"f-'", "eid - 1", "'\", null]'")
                + " WHEN 2 THEN '[]' WHEN 3 THEN '{\"a\": 1}' ELSE "
                + text("'[\"f-'", "eid - 1", "'\",\"f-'", "eid", "'\",\"f-'", "eid - 40", "'\",\"\"]'") + " END",
            ),
        ],
        [
            ("root_cause", f"CASE WHEN no_result THEN NULL ELSE {text(repr('cause '), 'm', repr('  is   known'))} END"),
            ("suggested_fix", f"CASE WHEN no_result THEN NULL ELSE {text(repr('fix '), 'k')} END"),
            ("confidence", "CASE WHEN no_result THEN NULL ELSE cast(k AS DOUBLE) / 64 END"),
            ("headline", f"CASE WHEN no_result OR eid % 11 = 0 THEN NULL ELSE {text(repr('headline '), 'm')} END"),
            ("resolution_note", f"CASE WHEN status = 'resolved' AND eid % 2 = 0 THEN {text(repr('note '), 'eid')} END"),
            ("resolved_at", "CASE WHEN status = 'resolved' THEN at_ms + 3600000 END"),
        ],
    ]


FAILURE_OUT = [
    "id", "repo", "branch", "provider", "pipeline_id", "job_name", "run_url", "commit_sha",
    "signature_hash", "signature_text", "category", "file_hint", "excerpt", "signature_confidence",
    "status", "root_cause", "suggested_fix", "confidence", "headline", "is_likely_flake",
    "cited_text", "resolution_note", "resolved_at", "occurrence_count", "created_at", "last_seen_at",
]


def run_steps(d):
    detail = (
        "CASE WHEN n = 5 AND eid % 3 = 0 THEN "
        + text(
            "'  {\"rootCause\": \"cause '", "m", "'\", \"confidence\": 0.'", "k % 10",
            "', \"isLikelyFlake\": true, \"headline\": \"from run\", \"citedFailureIds\": [\"f-'",
            "eid", "'\", \"f-'", "eid - 2", "'\"]}'",
        )
        + " WHEN n = 3 AND eid % 4 = 0 THEN '{\"suggestedFix\": \"retry\", \"rootCause\": null, \"headline\": 7}'"
        + " WHEN n = 1 AND eid % 6 = 0 THEN '{broken' WHEN n % 2 = 0 THEN NULL ELSE "
        + text("'done '", "k") + " END"
    )
    return [
        base_step(d),
        [("n", d.expand(6))],
        [
            ("id", text("'r-'", "eid", "'-'", "n")),
            ("failure_id", text("'f-'", "eid")),
            ("workflow_id", text("'w-'", "eid")),
            ("step", pick("floor(n / 2)", ["parse-log", "embed-signature", "analyse"])),
            (
                "status",
                "CASE WHEN n % 2 = 0 THEN 'started' WHEN (eid + n) % 5 = 0 THEN 'error'"
                " WHEN (eid + n) % 17 = 0 THEN 'weird' ELSE 'ok' END",
            ),
            ("detail", detail),
            ("duration_ms", "CASE WHEN n % 2 = 1 THEN k + n END"),
            ("created_at", "at_ms + n * 100 - n % 2 * 100"),
        ],
    ]


RUN_OUT = ["id", "failure_id", "workflow_id", "step", "status", "detail", "duration_ms", "created_at"]


def log_steps(d):
    q = "chr(39)"
    core = [
        lines(text("'FAIL src/mod'", "m", "'/cart.test.ts'"), text("'  ● cart totals '", "m", "' › applies discount'"),
              "'    expect(received).toBe(expected)'", text("'    Expected: '", "k")),
        text("stamp", "' Error: connect ECONNREFUSED 10.0.0.'", "k", "':5432'"),
        "'##[error]Process completed with exit code 137.'",
        lines(text("'src/app/main'", "m", "'.ts('", "k", "',17): error TS2345: Argument of type X is not assignable'"),
              "'Found 1 error.'"),
        lines("'npm ERR! code ERESOLVE'", "'npm ERR! ERESOLVE unable to resolve dependency tree'"),
        text("'[ERROR] Failed to execute goal on project svc: Could not resolve dependencies for project com.acme:svc'", "m", "':jar:1.0'"),
        text("'Build timed out (after '", "k", "' minutes). Marking the build as aborted.'"),
        "'##[error]The operation was canceled.'",
        lines("'  12:5   error  Unexpected console statement  no-console'", "''",
              text("'✖ '", "k + 1", "' problems ('", "k + 1", "' errors, 0 warnings)'")),
        text("'remote: Permission to acme-corp/app'", "m", "'.git denied to bot.'"),
        text("'curl: (6) Could not resolve host: registry'", "m", "'.example.test'"),
        text("chr(27)", "'[31mFAILED'", "chr(27)", "'[0m tests/test_billing.py::test_split_'", "m", "' - AssertionError'"),
        text("'[ERROR] /var/lib/jenkins/workspace/x/src/main/java/com/acme/Inv'", "m", "'.java:['", "k", "',38] cannot find symbol'"),
        lines(text("'hello from step '", "k"), "'nothing to see'", "'nothing to see'"),
        "'> Task :app:compileJava FAILED'",
        text("'would reformat src/mod'", "m", "'.py'"),
        "'sudo: a password is required'",
        text("'Process completed with exit code '", "k + 1", "'.'"),
        "'java.net.SocketTimeoutException: Read timed out'",
        text("'Tests:       '", "k % 5", "' failed, 3 passed, 4 total'"),
        "''",
        text("'Error: Cannot find module '", q, "'./util'", "m", q),
        lines(text("'runner pid '", "k", "' on host build'", "m", "'.example.test:8080 took '", "k", "'.5 s at 0xdeadbeef'", "m"),
              text("'ERROR: broken object 9abc'", "k", "'def12 of '", "k", "' MB'")),
        text("'ModuleNotFoundError: No module named x'", "m"),
        "'timeout: sending signal TERM to command npm'",
        lines("'FAIL src/big.test.ts'", "'  ● big suite › explodes'",
              "'FATAL ERROR: Reached heap limit Allocation failed - JavaScript heap out of memory'",
              "'##[error]Process completed with exit code 134.'"),
    ]
    arms = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(core))
    head = lines(
        text("stamp", "' [INFO] Building module-'", "m", "' run '", "eid"),
        text("'Downloading https://repo.example.test/pkg-'", "k", "'.jar (12 kB)'"),
        "'[INFO] ------------------------'",
    )
    tail = lines(
        text("'    at com.acme.mod'", "m", "'.ServiceTest.shouldRun(ServiceTest.java:'", "k", "')'"),
        text("'/home/runner/work/app/app/src/mod'", "m", "'/file.test.ts:'", "k", "':5'"),
        text("'commit 9'", f"substr({d.sha(text('eid'))}, 1, 11)", "' build #'", "eid"),
        "'   |      ^^^^'",
        text("'elapsed '", "k", "' ms, line '", "k"),
        "'done'",
    )
    stamp = text("'2024-02-03T04:05:'", "lpad(cast(k % 60 AS STRING), 2, '0')", "'.'", "eid % 1000", "'Z'")
    return [
        base_step(d),
        [("stamp", stamp), ("tpl", "(uid * 7 + eid) % 26")],
        [("core", f"CASE tpl {arms} END")],
        [
            ("log_id", "eid"),
            (
                "log_text",
                f"CASE WHEN tpl = 20 THEN {pick('eid % 3', ['', '   ', None]).replace('NULL', NL + ' || ' + NL)}"
                f" WHEN eid % 2 = 0 THEN {head} || {NL} || core || {NL} || {tail}"
                f" ELSE {head} || {NL} || core END",
            ),
        ],
    ]


def delivery_steps(d):
    esc = f"replace(replace(log_text, chr(27), chr(92) || 'u001b'), {NL}, chr(92) || 'n')"
    common = ["'\"logs\": \"'", "log_json", "'\"'"]
    bodies = [
        text("'{\"workflow_run\": {\"id\": '", "eid", "', \"name\": \"ci-'", "m", "'\", \"status\": \"completed\", \"conclusion\": \"Failure\", \"head_branch\": \"refs/heads/main\", \"html_url\": \"https://x.test/'", "eid", "'\", \"head_sha\": \"abc'", "k", "'\", \"updated_at\": \"2024-01-05T10:00:'", "lpad(cast(k % 60 AS STRING), 2, '0')", "'Z\", \"actor\": {\"login\": \"u'", "uid", "'\"}}, \"repository\": {\"full_name\": \"acme/repo-'", "uid % 20", "'\"}, '", *common, "'}'"),
        text("'{\"check_run\": {\"id\": '", "eid", "', \"status\": \"completed\", \"conclusion\": \"timed_out\", \"output\": {\"title\": \"check '", "m", "'\", \"summary\": \" \", \"text\": \"timed out\"}, \"completed_at\": 17043'", "lpad(cast(eid % 100000 AS STRING), 5, '0')", "', \"check_suite\": {\"head_branch\": \"origin/dev\"}}, \"repository\": {\"name\": \"repo-'", "uid % 20", "'\"}, \"sender\": {\"login\": \"bot\"}}'"),
        text("'{\"workflow_run\": {\"id\": '", "eid", "', \"status\": \"completed\", \"conclusion\": \"success\"}, \"repository\": {\"full_name\": \"acme/repo-1\"}}'"),
        text("'{\"workflow_run\": {\"id\": '", "eid", "', \"status\": \"in_progress\"}, \"repository\": {\"full_name\": \"acme/repo-1\"}, \"message\": \"still running '", "k", "'\", \"repo\": \"acme/manual\"}'"),
        text("'{\"name\": \"job-'", "m", "'\", \"build\": {\"number\": '", "k", "', \"phase\": \"finalized\", \"status\": \"'", pick("eid % 3", ["FAILURE", "unstable", "ERROR"]), "'\", \"full_url\": \"https://j.test/'", "eid", "'\", \"timestamp\": '", "at_ms", "', \"scm\": {\"url\": \"'", pick("uid % 3", ["git@github.com:acme/api.git", "https://host.test/acme/svc.git", "nohost"]), "'\", \"branch\": \"origin/main\", \"commit\": \"c'", "k", "'\"}, \"log\": \"'", "log_json", "'\"}}'"),
        text("'{\"name\": \"job-'", "m", "'\", \"build\": {\"number\": '", "k", "', \"phase\": \"'", pick("eid % 2", ["STARTED", "COMPLETED"]), "'\", \"status\": \"'", pick("eid % 3", ["SUCCESS", "FAILED", "SUCCESS"]), "'\"}}'"),
        text("'{\"object_kind\": \"'", pick("eid % 3", ["pipeline", "build", "push"]), "'\", \"object_attributes\": {\"id\": '", "eid", "', \"status\": \"failed\", \"ref\": \"main\", \"finished_at\": \"2024-01-07T00:00:00Z\", \"url\": \"https://gl.test/'", "eid", "'\"}, \"project\": {\"path_with_namespace\": \"grp/p'", "m", "'\"}, \"user\": {\"username\": \"gl'", "uid", "'\"}, \"build_log\": \"'", "log_json", "'\"}'"),
        text("'{\"object_kind\": \"job\", \"build_status\": \"'", pick("eid % 2", ["running", "Failed"]), "'\", \"build_id\": '", "eid", "', \"build_name\": \"test\", \"ref\": \"refs/heads/x\", \"project\": {\"name\": \"p\"}, \"commit\": {\"sha\": \"s'", "k", "'\"}}'"),
        text("'{\"repo\": \" acme/m'", "m", "' \", \"provider\": \"'", pick("eid % 4", ["GitHub", "Manual", "other", "jenkins"]), "'\", \"branch\": \"main\", \"timestamp\": \"'", "at_ms", "'\", \"requireApproval\": '", pick("eid % 2", ["true", "false"]), "', \"logText\": \"'", "log_json", "'\"}'"),
        text("'{\"logText\": \"'", "log_json", "'\", \"approval\": 1}'"),
        text("'{\"repo\": '", "eid"),
        pick("uid % 4", ["", "  ", "[1, 2]", "42"]),
    ]
    arms = " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(bodies))
    inner, outer = pads(SECRET)
    none = "''"
    return log_steps(d)[:-1] + [
        log_steps(d)[-1],
        [("log_json", esc), ("delivery_id", text("'d-'", "eid")), ("received_at", "at_ms")],
        [("raw_body", f"CASE mod(eid * 5 + uid, 12) {arms} END")],
        [("digest", d.hmac("raw_body", inner, outer))],
        [
            (
                "headers",
                "CASE eid % 6 WHEN 0 THEN " + d.headers([("'x-github-event'", "'workflow_run'"), ("'x-hub-signature-256'", "'SHA256=' || upper(digest)")])
                + " WHEN 1 THEN " + d.headers([("'x-gitlab-event'", "'Pipeline Hook'"), ("'x-gitlab-signature-256'", "digest")])
                + " WHEN 2 THEN " + d.headers([("'x-jenkins'", "'2.4'"), ("'x-jenkins-signature'", "'not hex'")])
                + " WHEN 3 THEN " + d.headers([("'content-type'", "'application/json'"), ("'x-webhook-signature'", "substr(digest, 2) || '0'")])
                + " WHEN 4 THEN " + d.headers([("'x-github-delivery'", none), ("'x-signature-256'", "' ' || digest || ' '")])
                + " ELSE " + d.headers([("'content-type'", "'application/json'")]) + " END",
            ),
        ],
    ]


def claim_steps(d):
    return [
        base_step(d),
        [
            ("repo", text("'acme/repo-'", "uid % 4")),
            ("signature_hash", f"substr({d.sha('et')}, 1, 32)"),
            ("eid_text", text("eid")),
            ("claimed", "1704067200000 + cast(floor((at_ms - 1704067200000) / 10) AS BIGINT)"),
            ("n", d.expand(2)),
        ],
        [
            ("event_id", "eid * 2 + n"),
            # the release of an odd event comes from a failure that does not hold the claim
            ("failure_id", "CASE WHEN n = 1 AND eid % 2 = 1 THEN 'g-' ELSE 'f-' END || eid_text"),
            ("kind", "CASE WHEN n = 0 THEN 'claim' WHEN eid % 29 = 0 THEN 'forget' ELSE 'release' END"),
            ("ts", "CASE WHEN n = 0 THEN claimed ELSE claimed + k * 12000 END"),
        ],
    ]


def approval_steps(d):
    return [
        base_step(d),
        [("n", d.expand(2))],
        [
            ("failure_id", text("'f-'", "eid")),
            ("approved", "(eid + n) % 3 <> 0"),
            ("edited_fix", pick("mod(eid + n, 4)", ["  better fix ", "  ", None, None])),
            ("reviewer", text("'rev-'", "uid % 7")),
            ("ts", "at_ms + (k * (n + 1) - 5) * 60000"),
            ("event_id", "eid * 2 + n"),
        ],
    ]


def vector_steps(d):
    return [
        [
            ("id", text("'v-'", "vec_id")),
            ("repo", text("'acme/repo-'", "label")),
            ("status", pick("vec_id % 4", ["resolved", "open", "dismissed", "resolved"])),
            ("last_seen_at", "1704067200000 + (vec_id * 7919) % 100003 * 1000"),
            ("zeroed", "vec_id % 10 = 0"),
            ("signature_text", text("'signature '", "vec_id")),
            ("raw", "embedding"),
        ],
        [("vector", f"CASE WHEN zeroed THEN {d.vector_zeros('raw')} ELSE raw END")],
    ]


def message_steps(d):
    return [
        [
            ("repo", text("'acme/repo-'", "conv_id % 37")),
            ("id", "conv_id * 1000 + turn"),
            ("content", "text"),
            ("created_at", "1704067200000 + conv_id * 60000 + turn * 1000"),
        ]
    ]


def reply_steps(d):
    quoted = d.json_quote("text")
    tick = "'```'"
    good = text(
        "'{\"rootCause\": '", quoted, "', \"suggestedFix\": \"do '", "doc_id % 9", "' {braces} please\", \"confidence\": '",
        pick("doc_id % 6", ["0.8", "85", "\"70%\"", "\"0.4\"", "\"x\"", "null"]),
        "', \"isLikelyFlake\": '", pick("doc_id % 5", ["true", "\"no\"", "\"maybe\"", "0", "null"]),
        "', \"citedFailureIds\": '", pick("doc_id % 4", ["[\"f-1\", \"f-2\", \"f-1\", 7]", "\"f-2, f-3 f-9\"", "[]", "null"]),
        "', \"headline\": '", pick("doc_id % 3", ["\"Short headline\"", "null", "\"\""]), "'}'",
    )
    return [
        [("n", d.expand(2))],
        [("good", good)],
        [
            ("failure_id", text("'f-'", "doc_id")),
            ("attempt", "n"),
            ("category", pick("doc_id % 9", CATEGORY_BY_NUMBER)),
            ("signature_text", text("'signature   '", "doc_id", NL, "'line two'")),
            (
                "reply",
                f"CASE mod(doc_id + n * 3, 8) WHEN 0 THEN good WHEN 1 THEN {tick} || 'json' || {NL} || good || {NL} || {tick}"
                f" WHEN 2 THEN 'Here is the JSON: ' || good || ' Hope that helps.' WHEN 3 THEN text"
                f" WHEN 4 THEN 'Example {{\"a\": {{\"b\": 1}}}} then ' || good WHEN 5 THEN '{{\"rootCause\": \"cut'"
                f" WHEN 6 THEN '' ELSE '{{\"analysis\": \"only cause\", \"confidence\": true}}' END",
            ),
        ],
        [
            (
                "response",
                "CASE doc_id % 6 WHEN 0 THEN " + d.json_quote("reply")
                + " WHEN 1 THEN '{\"response\": ' || " + d.json_quote("reply") + " || '}'"
                + " WHEN 2 THEN '{\"response\": {\"rootCause\":\"parsed\"}, \"usage\": {}}'"
                + " WHEN 3 THEN '{\"response\": \" \", \"choices\": [{\"message\": {\"content\": ' || " + d.json_quote("reply") + " || '}}]}'"
                + " WHEN 4 THEN '{\"response\": null}' ELSE 'not json' END",
            ),
        ],
    ]


def frame_steps(d):
    """Recorded answer frames: one frame per conversation turn, plus keep-alives."""
    return [
        [("n", d.expand(4))],
        [
            ("stream_id", "conv_id"),
            ("seq", "turn * 4 + n"),
            (
                "line",
                "CASE n WHEN 0 THEN 'data: {\"response\": ' || " + d.json_quote("text") + " || '}'"
                " WHEN 1 THEN " + text("'data:{\"response\":'", "turn", "'}'")
                + " WHEN 2 THEN CASE turn % 3 WHEN 0 THEN ': keep-alive' WHEN 1 THEN 'data: {broken' ELSE 'data: {\"response\": true}' END"
                " ELSE CASE turn % 2 WHEN 0 THEN 'data: [DONE]' ELSE 'data: ' END END",
            ),
        ],
    ]


def transcript_steps(d):
    q = d.json_quote("text")
    return [
        [
            ("session", "conv_id"),
            ("line_no", "turn"),
            (
                "line",
                "CASE WHEN role = 'user' AND turn % 3 = 0 THEN '{\"type\": \"user\", \"message\": {\"content\": ' || " + q + " || '}}'"
                " WHEN role = 'user' AND conv_id % 4 = 0 THEN '{\"type\": \"user\", \"message\": {\"content\": [{\"type\": \"tool_result\", \"content\": \"x\"}]}}'"
                " WHEN role = 'user' AND conv_id % 4 = 1 THEN '{\"type\": \"user\", \"message\": {\"content\": \"<system-reminder> hi\"}}'"
                " WHEN role = 'user' THEN '{\"type\": \"user\", \"message\": {\"content\": [{\"type\": \"text\", \"text\": ' || " + q + " || '}, {\"type\": \"image\"}, {\"type\": \"text\", \"text\": \"api_key: abcdefghijklmnop1234 end\"}]}}'"
                " WHEN role = 'assistant' AND conv_id % 3 = 0 THEN '{\"type\": \"assistant\", \"message\": {\"content\": [{\"type\": \"tool_use\", \"name\": \"Agent\", \"input\": {\"prompt\": ' || " + q + " || ', \"description\": \"look\"}}, {\"type\": \"tool_use\", \"name\": \"Agent\", \"input\": {\"prompt\": \"second\"}}, {\"type\": \"tool_use\", \"name\": \"Bash\", \"input\": {\"prompt\": \"no\"}}]}}'"
                " WHEN role = 'assistant' AND conv_id % 3 = 1 THEN '{\"type\": \"assistant\", \"message\": {\"content\": \"plain\"}}'"
                " WHEN role = 'assistant' THEN '{not json' ELSE '   ' END",
            ),
        ]
    ]


# name -> (table, steps, columns kept)
VIEWS = {
    "fx_failures": ("events", failure_steps, FAILURE_OUT),
    "fx_runs": ("events", run_steps, RUN_OUT),
    "fx_logs": ("events", log_steps, ["log_id", "log_text"]),
    "fx_deliveries": ("events", delivery_steps, ["delivery_id", "received_at", "headers", "raw_body"]),
    "fx_claims": ("events", claim_steps, ["repo", "signature_hash", "failure_id", "ts", "kind", "event_id"]),
    "fx_approvals": ("events", approval_steps, ["failure_id", "approved", "edited_fix", "reviewer", "ts", "event_id"]),
    "fx_vectors": ("embeddings", vector_steps, ["id", "repo", "status", "last_seen_at", "signature_text", "vector", "raw"]),
    "fx_messages": ("conversations", message_steps, ["repo", "id", "role", "content", "created_at"]),
    "fx_replies": ("documents", reply_steps, ["failure_id", "attempt", "category", "signature_text", "reply", "response"]),
    "fx_objects": ("documents", reply_steps, ["failure_id", "attempt", "category", "signature_text", "good"]),
    "fx_frames": ("conversations", frame_steps, ["stream_id", "seq", "line"]),
    "fx_transcripts": ("conversations", transcript_steps, ["session", "line_no", "line"]),
}


ROW_KEYS = {
    "events": "event_id", "embeddings": "vec_id", "documents": "doc_id", "conversations": "conv_id",
}
WIDE_TEXT = ["fx_logs", "fx_deliveries", "fx_replies", "fx_objects", "fx_frames", "fx_transcripts"]


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, steps, columns = VIEWS[name]
    df = spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"), ROW_KEYS[table])
    for step in steps(SparkDialect):
        fresh = {n for n, _ in step}
        df = df.selectExpr(*[c for c in df.columns if c not in fresh], *[f"{e} AS {n}" for n, e in step])
    if name not in WIDE_TEXT:
        return df.select(*columns)
    # a generator computes the long texts once per row: operators see columns, as on
    # a stored table, instead of inlining the template into every use
    return df.select(F.inline(F.array(F.struct(*columns))))


def duck_view(name: str) -> str:
    table, steps, columns = VIEWS[name]
    sql = table
    for step in steps(DuckDialect):
        exprs = ", ".join(f"{e} AS {n}" for n, e in step)
        source = sql if sql == table else f"({sql})"
        again = [n for n, _ in step if n in ("event_id", "ts")]
        star = f"* EXCLUDE ({', '.join(again)})" if again else "*"
        sql = f"SELECT {star}, {exprs} FROM {source}"
    return f"SELECT {', '.join(columns)} FROM ({sql})"
