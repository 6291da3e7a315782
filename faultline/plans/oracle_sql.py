"""SQL fragments for the checking database (RE2 regular expressions, no lookaround)."""

import re



from faultline.functions import patterns as P
from faultline.functions.text import WHITESPACE
from faultline.operators import ingest as I

WS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def spaces(x: str) -> str:
    return trim(f"regexp_replace({x}, '[\\s\\x{{00a0}}\\x{{3000}}\\x{{2000}}-\\x{{200a}}]+', ' ', 'g')")


def clip(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substring({x}, 1, {n - 1}) || '…' ELSE {x} END"


def one_line(x: str, n: int) -> str:
    return clip(spaces(f"coalesce({x}, '')"), n)


def cap(x: str, n: int) -> str:
    t = trim(f"coalesce({x}, '')")
    return f"CASE WHEN length({t}) > {n} THEN substring({t}, 1, {n}) || chr(10) || '…[truncated]' ELSE {t} END"


def days_ago(x: str, now: int) -> str:
    d = f"cast(floor(({now} - {x}) / 86400000.0) AS BIGINT)"
    return (
        f"CASE WHEN {x} IS NULL OR {x} = 0 THEN 'unknown date' WHEN {d} <= 0 THEN 'today'"
        f" WHEN {d} = 1 THEN '1 day ago' ELSE {d} || ' days ago' END"
    )


# ---- JSON ----------------------------------------------------------------------
def path(p: str) -> str:
    return "'$" + "".join(f'."{k}"' for k in p.split(".")) + "'"


def text_at(j: str, *paths: str) -> str:
    def one(p):
        return (
            f"CASE json_type({j}, {path(p)}) WHEN 'VARCHAR' THEN"
            f" nullif({trim(f'json_extract_string({j}, {path(p)})')}, '')"
            f" WHEN 'UBIGINT' THEN json_extract_string({j}, {path(p)})"
            f" WHEN 'BIGINT' THEN json_extract_string({j}, {path(p)})"
            f" WHEN 'DOUBLE' THEN json_extract_string({j}, {path(p)}) END"
        )

    return "coalesce(" + ", ".join(one(p) for p in paths) + ", NULL)"


def object_at(j: str, p: str) -> str:
    return f"CASE WHEN json_type({j}, {path(p)}) = 'OBJECT' THEN json_extract({j}, {path(p)}) END"


def millis_at(j: str, *paths: str) -> str:
    def one(p):
        s = f"json_extract_string({j}, {path(p)})"
        n = f"try_cast({s} AS DOUBLE)"
        return (
            f"CASE WHEN json_type({j}, {path(p)}) IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE') THEN"
            f" CASE WHEN {n} IS NOT NULL THEN cast(floor(CASE WHEN {n} < 1e12 THEN {n} * 1000 ELSE {n} END + 0.5) AS BIGINT)"
            f" ELSE epoch_ms(try_cast(replace({s}, 'Z', '') AS TIMESTAMP)) END END"
        )

    return "coalesce(" + ", ".join(one(p) for p in paths) + ", NULL)"


def branch(x: str) -> str:
    return f"coalesce({trim(f'''regexp_replace(regexp_replace({x}, '^refs/heads/', ''), '^origin/', '')''')}, '')"


def scm(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '\\.git$', ''), '/+$', '')"
    parts = f"list_filter(regexp_split_to_array({bare}, '[:/]'), lambda p: p <> '')"
    return f"CASE WHEN len({parts}) >= 2 THEN array_to_string({parts}[-2:], '/') END"


def header(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(headers['{n}'], '')" for n in names) + ", NULL)"


PAYLOADS = (
    "SELECT *, CASE WHEN json_valid(raw_body) AND json_type(raw_body) = 'OBJECT' THEN cast(raw_body AS JSON) END AS j"
    " FROM fx_deliveries"
)
LOG = I.LOG_KEYS


def in_list(items) -> str:
    return "(" + ", ".join(quote(i) for i in items) + ")"


def github() -> dict:
    job = f"coalesce({text_at('run', 'name', 'display_title')}, CASE WHEN is_check THEN 'check' ELSE 'workflow' END)"
    conclusion = f"lower({text_at('run', 'conclusion')})"
    repo = f"coalesce({text_at('j', 'repository.full_name', 'repository.name')}, {text_at('run', 'repository.full_name')})"
    output = f"nullif(concat_ws(chr(10), {text_at('run', 'output.title')}, {text_at('run', 'output.summary')}, {text_at('run', 'output.text')}), '')"
    return {
        "source": f"(SELECT *, coalesce({object_at('j', 'workflow_run')}, {object_at('j', 'check_run')}) AS run, ({object_at('j', 'check_run')}) IS NOT NULL AS is_check FROM sh_payloads WHERE j IS NOT NULL)",
        "fits": f"run IS NOT NULL AND coalesce({text_at('run', 'status')}, 'completed') = 'completed' AND {conclusion} IN {in_list(I.GITHUB_FAILURES)} AND {repo} IS NOT NULL",
        "provider": "'github'",
        "repo": repo,
        "branch": branch(f"coalesce({text_at('run', 'head_branch', 'check_suite.head_branch')}, {text_at('j', 'workflow_run.head_branch')})"),
        "pipeline_id": f"coalesce({text_at('run', 'id', 'run_number', 'check_suite.id')}, {text_at('j', 'repository.id')}, 'unknown')",
        "job_name": job,
        "run_url": text_at("run", "html_url", "url", "details_url"),
        "commit_sha": text_at("run", "head_sha", "head_commit.id"),
        "author": f"coalesce({text_at('run', 'head_commit.author.name', 'actor.login', 'triggering_actor.login')}, {text_at('j', 'sender.login')})",
        "log_text": f"coalesce({text_at('j', *LOG)}, {output}, 'GitHub Actions ' || CASE WHEN is_check THEN 'check_run' ELSE 'workflow_run' END || ' \"' || {job} || '\" concluded: ' || {conclusion} || '. No log body was included in the webhook payload.')",
        "occurred_at": millis_at("run", "updated_at", "completed_at", "created_at"),
    }


def jenkins() -> dict:
    status = f"upper({text_at('b', 'status')})"
    job = f"coalesce({text_at('j', 'name', 'displayName')}, 'jenkins-job')"
    return {
        "source": f"(SELECT *, {object_at('j', 'build')} AS b FROM sh_payloads WHERE j IS NOT NULL)",
        "fits": f"b IS NOT NULL AND coalesce(upper({text_at('b', 'phase')}), 'COMPLETED') IN {in_list(I.JENKINS_PHASES)} AND {status} IN {in_list(I.JENKINS_FAILURES)}",
        "provider": "'jenkins'",
        "repo": f"coalesce({scm(text_at('b', 'scm.url'))}, {job})",
        "branch": branch(text_at("b", "scm.branch")),
        "pipeline_id": f"coalesce({text_at('b', 'number', 'queue_id', 'url')}, 'unknown')",
        "job_name": job,
        "run_url": f"coalesce({text_at('b', 'full_url', 'url')}, {text_at('j', 'url')})",
        "commit_sha": text_at("b", "scm.commit"),
        "author": text_at("b", "parameters.author", "scm.culprits.0"),
        "log_text": f"coalesce({text_at('j', *LOG, 'build.log', 'build.consoleText', 'build.output')}, 'Jenkins job \"' || {job} || '\" build #' || coalesce({text_at('b', 'number')}, '?') || ' finished with status ' || {status} || '. No console log was included in the notification payload.')",
        "occurred_at": millis_at("b", "timestamp"),
    }


def gitlab() -> dict:
    kind = text_at("j", "object_kind")
    status = f"lower(coalesce({text_at('a', 'status')}, {text_at('j', 'build_status', 'status')}))"
    repo = text_at("j", "project.path_with_namespace", "project.name", "repository.name")
    job = f"coalesce({text_at('j', 'build_name')}, {text_at('a', 'name', 'ref')}, 'pipeline')"
    return {
        "source": f"(SELECT *, {object_at('j', 'object_attributes')} AS a FROM sh_payloads WHERE j IS NOT NULL)",
        "fits": f"{kind} IN {in_list(I.GITLAB_KINDS)} AND {status} IN {in_list(I.GITLAB_FAILURES)} AND {repo} IS NOT NULL",
        "provider": "'gitlab'",
        "repo": repo,
        "branch": branch(f"coalesce({text_at('a', 'ref')}, {text_at('j', 'ref')})"),
        "pipeline_id": f"coalesce({text_at('a', 'id')}, {text_at('j', 'build_id', 'pipeline_id')}, 'unknown')",
        "job_name": job,
        "run_url": f"coalesce({text_at('a', 'url')}, {text_at('j', 'project.web_url')})",
        "commit_sha": f"coalesce({text_at('j', 'commit.sha', 'commit.id')}, {text_at('a', 'sha')})",
        "author": text_at("j", "user.username", "user.name", "commit.author.name"),
        "log_text": f"coalesce({text_at('j', *LOG, 'build_log', 'object_attributes.log')}, 'GitLab ' || {kind} || ' \"' || {job} || '\" finished with status ' || {status} || '. No job log was included in the webhook payload.')",
        "occurred_at": f"coalesce({millis_at('a', 'finished_at')}, {millis_at('j', 'build_finished_at')})",
    }


def manual() -> dict:
    repo = text_at("j", "repo", "repository", "repo_name", "repoName", "project", "repository.full_name")
    log = text_at("j", *LOG, "message", "error", "text")
    hint = f"lower({text_at('j', 'provider')})"
    return {
        "source": "(SELECT * FROM sh_payloads WHERE j IS NOT NULL)",
        "fits": f"{repo} IS NOT NULL AND {log} IS NOT NULL",
        "provider": f"CASE WHEN {hint} IN ('github', 'jenkins', 'gitlab') THEN {hint} ELSE 'manual' END",
        "repo": repo,
        "branch": branch(text_at("j", "branch", "ref", "head_branch")),
        "pipeline_id": f"coalesce({text_at('j', 'pipelineId', 'pipeline_id', 'runId', 'run_id', 'buildNumber', 'build_number')}, 'manual-' || delivery_id)",
        "job_name": f"coalesce({text_at('j', 'jobName', 'job_name', 'job', 'workflow', 'name')}, 'manual')",
        "run_url": text_at("j", "runUrl", "run_url", "url", "html_url"),
        "commit_sha": text_at("j", "commitSha", "commit_sha", "commit", "sha"),
        "author": text_at("j", "author", "actor", "user"),
        "log_text": log,
        "occurred_at": millis_at("j", "occurredAt", "occurred_at", "timestamp"),
    }


def adapter(fields: dict) -> str:
    cols = ", ".join(f"{fields[n]} AS {n}" for n in I.INCOMING)
    return f"SELECT delivery_id, {cols} FROM {fields['source']} WHERE {fields['fits']}"


def provider() -> str:
    arms = " ".join(f"WHEN {header(*keys)} IS NOT NULL THEN '{name}'" for name, keys in I.PROVIDER_HEADERS)
    given = f"lower({text_at('j', 'provider')})"
    shape = " OR ".join(f"json_type(j, {path(k)}) NOT IN ('NULL')" for k in ("workflow_run", "check_run", "workflow_job"))
    return (
        f"CASE {arms} WHEN {given} IN ('github', 'gitlab', 'jenkins', 'manual') THEN {given}"
        f" WHEN {shape} THEN 'github' WHEN json_extract_string(j, '$.object_kind') <> '' THEN 'gitlab'"
        f" WHEN ({object_at('j', 'build')}) IS NOT NULL AND json_extract_string(j, '$.name') <> '' THEN 'jenkins'"
        f" WHEN {text_at('j', 'repository.full_name')} IS NOT NULL THEN 'github' ELSE 'manual' END"
    )


def reason() -> str:
    return (
        f"CASE WHEN {trim('raw_body')} = '' THEN 'body is required' WHEN j IS NOT NULL THEN NULL"
        " WHEN NOT json_valid(raw_body) THEN 'body is not valid JSON' ELSE 'body is not a JSON object' END"
    )


# ---- log lines -----------------------------------------------------------------
RE2_REWRITES = {
    11: (r"(^|[^\w.$-])(?:/[\w.+@%-]+)+/([\w.+@%-]+/[\w.+@%-]+)", r"\1\2"),
    12: (r"\b[A-Za-z]:(?:\\[\w.+@%-]+)*\\([\w.+@%-]+)\\([\w.+@%-]+)", r"\1/\2"),
    # at least one digit among 7 to 64 hex characters, by the place of the first digit
    26: (
        r"\b(?:"
        + "|".join(f"[a-f]{{{i}}}[0-9][0-9a-f]{{{6 - i},{63 - i}}}" for i in range(7))
        + r"|[a-f]{7,62}[0-9][0-9a-f]{0,56})\b",
        "<HEX>",
    ),
}


def normalise(x: str) -> str:
    for i, (pattern, to) in enumerate(P.REWRITES):
        pattern, to = RE2_REWRITES.get(i, (pattern, to.replace("$", "\\")))
        x = f"regexp_replace({x}, {quote(pattern)}, {quote(to)}, 'g')"
    return trim(x)


def re2(pattern: str) -> str:
    return (
        pattern.replace("(?!Console)", "")
        .replace(r"(?!0\b)\d{1,6}", r"[1-9]\d{0,5}")
        .replace(r"(?!0\b)\d{1,3}", r"[1-9]\d{0,2}")
    )


def any_of(alternatives) -> str:
    return quote("|".join(f"(?:{re2(p)})" for p in alternatives))


def rule(x: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({x}, {any_of(r[3])}) THEN {i}" for i, r in enumerate(P.RULES))
    return f"CASE {arms} END"


def rule_field(x: str, field: int) -> str:
    return f"CASE {x} " + " ".join(
        f"WHEN {i} THEN {quote(r[field]) if isinstance(r[field], str) else r[field]}" for i, r in enumerate(P.RULES)
    ) + " END"


def noise(x: str) -> str:
    return f"(length({x}) < 3 OR regexp_matches({x}, {any_of(P.NOISE)}))"


def extract(x: str, pattern: str) -> str:
    return f"nullif(regexp_extract({x}, {quote(pattern)}, 1), '')"


def hint_query(lines: str, keys: str) -> str:
    """Hint per key over rows (keys, i, n) of normalised lines."""
    file = extract("n", P.SOURCE_FILE)
    return (
        f"SELECT {keys}, coalesce(arg_min(py, i) FILTER (py IS NOT NULL),"
        f" arg_min(f, i) FILTER (regexp_matches(f, {quote(P.TEST_FILE)})),"
        f" arg_min(jc, i) FILTER (jc IS NOT NULL), arg_min(f, i) FILTER (f IS NOT NULL),"
        f" arg_min(b, i) FILTER (b IS NOT NULL)) AS hint FROM (SELECT {keys}, i,"
        f" {extract('n', P.PYTEST_NODE)} AS py,"
        f" CASE WHEN {file} LIKE '%node_modules/%' THEN NULL ELSE {file} END AS f,"
        f" {extract('n', P.JAVA_CLASS)} AS jc, {extract('n', P.BULLET_TITLE)} AS b FROM {lines}) GROUP BY {keys}"
    )


LINES = (
    "SELECT log_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i, len(l) AS total FROM ("
    "SELECT log_id, string_split(right(log_text, 512000), chr(10))[-2001:] AS l FROM fx_logs)"
)
NORMAL = f"SELECT *, {normalise('line')} AS n FROM sh_lines"
CANDIDATES = (
    f"SELECT log_id, i, line, n FROM sh_normal WHERE length(line) > 0 AND length(line) < 4000"
    f" AND regexp_matches(line, {quote('(?i)' + '|'.join(re.escape(w) for w in P.TRIGGER_WORDS))})"
    " QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY i DESC) <= 200"
)
HITS = (
    f"SELECT log_id, i AS m, rule, {rule_field('rule', 1)} AS priority FROM ("
    f"SELECT log_id, i, {rule('n')} AS rule FROM sh_candidates) WHERE rule IS NOT NULL"
)
BEST = "SELECT * FROM sh_hits QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY priority, m DESC) = 1"
DISTINCT = (
    "SELECT log_id, i, t FROM ("
    f"SELECT b.log_id, i, {clip('n', 240)} AS t FROM sh_normal l JOIN sh_best b"
    f" ON l.log_id = b.log_id AND i BETWEEN m AND m + 23 WHERE n <> '' AND (i = m OR NOT {noise('n')})"
    ") QUALIFY row_number() OVER (PARTITION BY log_id, t ORDER BY i) = 1"
)
TEXTS = (
    "SELECT log_id, string_agg(t, chr(10) ORDER BY i) AS text FROM ("
    "SELECT * FROM sh_distinct QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY i) <= 5) GROUP BY log_id"
)


def excerpt(anchor: str, key_table: str) -> str:
    return (
        "SELECT l.log_id, substring(string_agg(line, chr(10) ORDER BY i), 1, 4000) AS excerpt FROM sh_lines l"
        f" JOIN {key_table} k ON l.log_id = k.log_id WHERE i >= {anchor} - 6 AND i < {anchor} + 34 GROUP BY l.log_id"
    )


FORWARD = hint_query("(SELECT b.log_id, i, n FROM sh_normal l JOIN sh_best b ON l.log_id = b.log_id AND i >= m AND i < m + 34)", "log_id")
BACKWARD = hint_query("(SELECT b.log_id, i, n FROM sh_normal l JOIN sh_best b ON l.log_id = b.log_id AND i < m AND i >= m - 20)", "log_id")
LAST_HINT = hint_query("(SELECT log_id, i, n FROM sh_normal WHERE i >= total - 40)", "log_id")
FALLBACK_TEXT = (
    "SELECT log_id, string_agg(t, chr(10) ORDER BY i) AS text FROM ("
    f"SELECT log_id, i, {clip('n', 240)} AS t FROM sh_normal WHERE n <> '' AND NOT {noise('n')}"
    " QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY i DESC) <= 5) GROUP BY log_id"
)
SHARED = {
    "sh_lines": LINES,
    "sh_normal": NORMAL,
    "sh_candidates": CANDIDATES,
    "sh_hits": HITS,
    "sh_best": BEST,
    "sh_distinct": DISTINCT,
    "sh_texts": TEXTS,
    "sh_totals": f"SELECT log_id, max(total) AS total, count(*) FILTER ({trim('line')} <> '') AS filled FROM sh_lines GROUP BY log_id",
    "sh_excerpts": excerpt("m", "sh_best"),
    "sh_forward": FORWARD,
    "sh_backward": BACKWARD,
    "sh_last_hint": LAST_HINT,
    "sh_fallback_text": FALLBACK_TEXT,
    "sh_fallback_excerpt": excerpt("greatest(k.total - 34, 0)", "sh_totals"),
    "sh_fallback": (
        "SELECT log_id, coalesce(text, 'unclassified failure') AS text, hint AS file_hint, excerpt FROM sh_totals"
        " LEFT JOIN sh_fallback_text USING (log_id) LEFT JOIN sh_last_hint USING (log_id)"
        " LEFT JOIN sh_fallback_excerpt USING (log_id)"
    ),
    "sh_matched": (
        f"SELECT b.log_id, text, {rule_field('rule', 0)} AS category, {rule_field('rule', 2)} AS confidence, excerpt,"
        f" coalesce(f.hint, CASE WHEN {rule_field('rule', 0)} IN ('test_failure', 'compile_error', 'lint_error') THEN k.hint END) AS file_hint"
        " FROM sh_best b JOIN sh_texts USING (log_id) JOIN sh_excerpts USING (log_id)"
        " LEFT JOIN sh_forward f ON f.log_id = b.log_id LEFT JOIN sh_backward k ON k.log_id = b.log_id"
    ),
    "sh_signatures": (
        "SELECT log_id, substring(sha256(category || chr(10) || text), 1, 32) AS hash, text, category, file_hint, excerpt, confidence FROM ("
        "SELECT t.log_id,"
        " CASE WHEN filled = 0 THEN 'empty log' WHEN m.log_id IS NOT NULL THEN m.text ELSE f.text END AS text,"
        " CASE WHEN filled > 0 AND m.log_id IS NOT NULL THEN m.category ELSE 'unknown' END AS category,"
        " CASE WHEN filled = 0 THEN NULL WHEN m.log_id IS NOT NULL THEN m.file_hint ELSE f.file_hint END AS file_hint,"
        " CASE WHEN filled = 0 THEN '' WHEN m.log_id IS NOT NULL THEN m.excerpt ELSE f.excerpt END AS excerpt,"
        " cast(CASE WHEN filled = 0 THEN 0 WHEN m.log_id IS NOT NULL THEN m.confidence ELSE 0.2 END AS DOUBLE) AS confidence"
        " FROM sh_totals t LEFT JOIN sh_matched m ON m.log_id = t.log_id JOIN sh_fallback f ON f.log_id = t.log_id)"
    ),
    "sh_payloads": PAYLOADS,
    "sh_github": adapter(github()),
    "sh_jenkins": adapter(jenkins()),
    "sh_gitlab": adapter(gitlab()),
    "sh_manual": adapter(manual()),
    "sh_failures": (
        "SELECT * EXCLUDE (cited_text), CASE WHEN json_valid(cited_text) AND json_type(cited_text) = 'ARRAY' THEN"
        " list_transform(list_filter(cast(json_extract(cited_text, '$[*]') AS JSON[]), lambda x: json_type(x) = 'VARCHAR'),"
        " lambda x: json_extract_string(x, '$')) ELSE cast([] AS VARCHAR[]) END AS cited_failure_ids FROM fx_failures"
    ),
}

# the log tables once more, over whole documents
DOCUMENTS = "(SELECT doc_id AS log_id, text AS log_text FROM documents)"
SHARED.update(
    {
        name.replace("sh_", "sd_"): sql.replace("sh_", "sd_").replace("fx_logs", DOCUMENTS)
        for name, sql in list(SHARED.items())
        if "fx_" not in sql.replace("fx_logs", "") and name not in ("sh_github", "sh_jenkins", "sh_gitlab", "sh_manual")
    }
)
