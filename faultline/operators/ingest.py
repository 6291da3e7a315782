"""Webhook deliveries to normalised failures: (delivery_id, received_at, headers, raw_body)."""

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.functions import variants as V
from faultline.functions.reuse import once, once_per_context
from faultline.functions.text import col, filled, let, present, trim

# ---- fixed values: payload vocabulary ---------------------------------------
LOG_KEYS = ["logText", "log_text", "logs", "log", "output", "consoleText", "console_text", "body"]
GITHUB_FAILURES = ["failure", "timed_out", "startup_failure", "action_required"]
JENKINS_PHASES = ["COMPLETED", "FINALIZED"]
JENKINS_FAILURES = ["FAILURE", "FAILED", "UNSTABLE", "ERROR", "REGRESSION"]
GITLAB_KINDS = ["pipeline", "build", "job"]
GITLAB_FAILURES = ["failed", "failure"]
PROVIDER_HEADERS = [
    ("github", ["x-github-event", "x-github-delivery"]),
    ("gitlab", ["x-gitlab-event", "x-gitlab-token"]),
    ("jenkins", ["x-jenkins", "x-jenkins-event"]),
]
SIGNATURE_HEADERS = [
    "x-hub-signature-256",
    "x-gitlab-signature-256",
    "x-jenkins-signature",
    "x-signature-256",
    "x-webhook-signature",
]

INCOMING = [
    "provider", "repo", "branch", "pipeline_id", "job_name", "run_url", "commit_sha", "author",
    "log_text", "occurred_at",
]


# ---- sources -----------------------------------------------------------------
def guard_body_size(deliveries: DataFrame, limit: int = S.BODY_CHARS) -> DataFrame:
    """Flag bodies that are too long; ``accepted`` splits the table."""
    return deliveries.withColumn("accepted", F.length("raw_body") <= limit)


def parsed(deliveries: DataFrame) -> DataFrame:
    """Add the parsed body. The variant stays on the row and is never shuffled.

    The one-element generator makes the parse happen once per row; a plain
    projection would be inlined into every later filter and field.
    """
    return deliveries.select("*", F.explode(F.array(V.parse_object("raw_body"))).alias("payload"))


def body_reason(raw, payload) -> Column:
    """Why a body is unusable, or null."""
    body = trim(raw)
    return (
        F.when(col(raw).isNull() | (body == ""), "body is required")
        .when(payload.isNotNull(), None)
        .when(V.parse(body).isNull(), "body is not valid JSON")
        .otherwise("body is not a JSON object")
    )


def scan_deliveries(deliveries: DataFrame) -> DataFrame:
    """Deliveries with a ``reason``: null for a JSON object body, else why it is rejected."""
    return parsed(deliveries).select(
        "delivery_id", "raw_body", body_reason("raw_body", F.col("payload")).alias("reason")
    )


# ---- shared field expressions ------------------------------------------------
def header(headers, name: str) -> Column:
    """Non-empty header value; names compare without case."""
    hits = F.filter(
        F.map_entries(col(headers)), lambda e: (F.lower(e["key"]) == name) & (e["value"] != "")
    )
    return F.get(F.transform(hits, lambda e: e["value"]), F.lit(0))


def clean_branch(value) -> Column:
    bare = F.regexp_replace(F.regexp_replace(col(value), "^refs/heads/", ""), "^origin/", "")
    return F.coalesce(trim(bare), F.lit(""))


def repo_from_scm(url) -> Column:
    """Last two parts of a clone URL, or null when there are fewer."""
    bare = F.regexp_replace(F.regexp_replace(col(url), r"\.git$", ""), "/+$", "")
    return let(
        F.filter(F.split(bare, "[:/]"), lambda p: p != ""),
        lambda parts: F.when(
            F.size(parts) >= 2,
            F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/"),
        ),
    )


def log_text(payload, *paths: str) -> Column:
    return V.text_at(payload, *LOG_KEYS, *paths)


def incoming(**fields) -> Column:
    return F.struct(*[fields[name].cast("long" if name == "occurred_at" else "string").alias(name) for name in INCOMING])


UNCLEAR = "\x00?"  # stands for a text whose JSON type must be looked at


class Reader:
    """The texts and times an adapter reads from a payload, each by its path.

    An adapter written with a reader is an expression over one column of values, which
    ``values`` fills: every path is read once, all texts are cleaned by one function, and
    the plan stays flat and small however many paths there are.
    """

    def __init__(self, column: str):
        self.held = F.col(column)
        self.paths: dict[str, int] = {}
        self.times: dict[str, int] = {}

    def text(self, *paths: str) -> Column:
        """First path that holds a trimmed non-blank string, or a number as text."""
        return F.coalesce(*[self.one(p) for p in paths])

    def one(self, path: str) -> Column:
        place = self.paths.setdefault(path, len(self.paths))
        value = F.get(self.held["texts"], F.lit(place))
        return F.when(value == UNCLEAR, V.typed_text(V.at(F.col("payload"), path))).otherwise(value)

    def log_text(self, *paths: str) -> Column:
        return self.text(*LOG_KEYS, *paths)

    def millis(self, *paths: str) -> Column:
        places = [self.times.setdefault(p, len(self.times)) for p in paths]
        return F.coalesce(*[F.get(self.held["times"], F.lit(n)) for n in places])

    def values(self, wanted: Column) -> Column:
        """What the column holds on rows that are wanted; to be called when the adapter is written."""
        payload = F.col("payload")

        def cleaned(s):
            return F.when(V.is_unclear(s), UNCLEAR).otherwise(filled(s))

        texts = F.transform(F.array(*[V.string_at(payload, p) for p in self.paths]), cleaned)
        times = F.transform(F.array(*[V.at(payload, p) for p in self.times]), V.millis)
        return F.when(wanted, F.struct(texts.alias("texts"), times.alias("times")))


# ---- adapters: struct when the payload is a failure of that provider, else null
def is_object(path: str) -> Column:
    return F.coalesce(V.is_object(V.at(F.col("payload"), path)), F.lit(False))


def from_github(r: Reader) -> Column:
    is_run, is_check = is_object("workflow_run"), is_object("check_run")

    def of_run(read, *paths):
        """From the workflow run, or from the check run if there is no workflow run."""
        return F.when(is_run, read(*[f"workflow_run.{p}" for p in paths])).when(
            is_check, read(*[f"check_run.{p}" for p in paths])
        )

    def run(*paths):
        return of_run(r.text, *paths)

    status = run("status")
    conclusion = F.lower(run("conclusion"))
    repo = F.coalesce(r.text("repository.full_name", "repository.name"), run("repository.full_name"))
    job = F.coalesce(run("name", "display_title"), F.when(is_check, "check").otherwise("workflow"))
    output = F.concat_ws("\n", run("output.title"), run("output.summary"), run("output.text"))
    sentence = F.concat(
        F.lit("GitHub Actions "),
        F.when(is_check, "check_run").otherwise("workflow_run"),
        F.lit(' "'), job, F.lit('" concluded: '), conclusion,
        F.lit(". No log body was included in the webhook payload."),
    )
    out = incoming(
        provider=F.lit("github"),
        repo=repo,
        branch=clean_branch(
            F.coalesce(run("head_branch", "check_suite.head_branch"), r.text("workflow_run.head_branch"))
        ),
        pipeline_id=F.coalesce(
            run("id", "run_number", "check_suite.id"), r.text("repository.id"), F.lit("unknown")
        ),
        job_name=job,
        run_url=run("html_url", "url", "details_url"),
        commit_sha=run("head_sha", "head_commit.id"),
        author=F.coalesce(
            run("head_commit.author.name", "actor.login", "triggering_actor.login"), r.text("sender.login")
        ),
        log_text=F.coalesce(r.log_text(), present(output), sentence),
        occurred_at=of_run(r.millis, "updated_at", "completed_at", "created_at"),
    )
    fits = (
        (is_run | is_check)
        & (status.isNull() | (status == "completed"))
        & conclusion.isin(GITHUB_FAILURES)
        & repo.isNotNull()
    )
    return F.when(fits, out)


def from_jenkins(r: Reader) -> Column:
    phase = F.upper(r.text("build.phase"))
    status = F.upper(r.text("build.status"))
    job = F.coalesce(r.text("name", "displayName"), F.lit("jenkins-job"))
    sentence = F.concat(
        F.lit('Jenkins job "'), job, F.lit('" build #'),
        F.coalesce(r.text("build.number"), F.lit("?")),
        F.lit(" finished with status "), status,
        F.lit(". No console log was included in the notification payload."),
    )
    out = incoming(
        provider=F.lit("jenkins"),
        repo=F.coalesce(repo_from_scm(r.text("build.scm.url")), job),
        branch=clean_branch(r.text("build.scm.branch")),
        pipeline_id=F.coalesce(r.text("build.number", "build.queue_id", "build.url"), F.lit("unknown")),
        job_name=job,
        run_url=r.text("build.full_url", "build.url", "url"),
        commit_sha=r.text("build.scm.commit"),
        author=r.text("build.parameters.author", "build.scm.culprits.0"),
        log_text=F.coalesce(r.log_text("build.log", "build.consoleText", "build.output"), sentence),
        occurred_at=r.millis("build.timestamp"),
    )
    fits = (phase.isNull() | phase.isin(JENKINS_PHASES)) & status.isin(JENKINS_FAILURES)
    return F.when(is_object("build") & fits, out)


def from_gitlab(r: Reader) -> Column:
    has_attributes = is_object("object_attributes")

    def attribute(*paths):
        return F.when(has_attributes, r.text(*[f"object_attributes.{p}" for p in paths]))

    object_kind = r.text("object_kind")
    status = F.lower(F.coalesce(attribute("status"), r.text("build_status", "status")))
    repo = r.text("project.path_with_namespace", "project.name", "repository.name")
    job = F.coalesce(r.text("build_name"), attribute("name", "ref"), F.lit("pipeline"))
    sentence = F.concat(
        F.lit("GitLab "), object_kind, F.lit(' "'), job, F.lit('" finished with status '),
        status, F.lit(". No job log was included in the webhook payload."),
    )
    out = incoming(
        provider=F.lit("gitlab"),
        repo=repo,
        branch=clean_branch(F.coalesce(attribute("ref"), r.text("ref"))),
        pipeline_id=F.coalesce(attribute("id"), r.text("build_id", "pipeline_id"), F.lit("unknown")),
        job_name=job,
        run_url=F.coalesce(attribute("url"), r.text("project.web_url")),
        commit_sha=F.coalesce(r.text("commit.sha", "commit.id"), attribute("sha")),
        author=r.text("user.username", "user.name", "commit.author.name"),
        log_text=F.coalesce(r.log_text("build_log", "object_attributes.log"), sentence),
        occurred_at=F.coalesce(
            F.when(has_attributes, r.millis("object_attributes.finished_at")), r.millis("build_finished_at")
        ),
    )
    fits = object_kind.isin(GITLAB_KINDS) & status.isin(GITLAB_FAILURES) & repo.isNotNull()
    return F.when(fits, out)


def from_manual(r: Reader, default_id: str = "delivery_id") -> Column:
    """Permissive adapter: a repo and some log text are enough."""
    repo = r.text("repo", "repository", "repo_name", "repoName", "project", "repository.full_name")
    log = r.log_text("message", "error", "text")
    hint = F.lower(r.text("provider"))
    out = incoming(
        provider=F.when(hint.isin("github", "jenkins", "gitlab"), hint).otherwise("manual"),
        repo=repo,
        branch=clean_branch(r.text("branch", "ref", "head_branch")),
        pipeline_id=F.coalesce(
            r.text("pipelineId", "pipeline_id", "runId", "run_id", "buildNumber", "build_number"),
            F.concat(F.lit("manual-"), col(default_id)),
        ),
        job_name=F.coalesce(r.text("jobName", "job_name", "job", "workflow", "name"), F.lit("manual")),
        run_url=r.text("runUrl", "run_url", "url", "html_url"),
        commit_sha=r.text("commitSha", "commit_sha", "commit", "sha"),
        author=r.text("author", "actor", "user"),
        log_text=log,
        occurred_at=r.millis("occurredAt", "occurred_at", "timestamp"),
    )
    return F.when(repo.isNotNull() & log.isNotNull(), out)


ADAPTERS = {"github": from_github, "jenkins": from_jenkins, "gitlab": from_gitlab, "manual": from_manual}


def provider_of(headers, v) -> Column:
    """Provider by headers, then by the explicit field, then by payload shape."""
    found = None
    for name, keys in PROVIDER_HEADERS:
        test = F.coalesce(*[header(headers, k) for k in keys]).isNotNull()
        found = F.when(test, name) if found is None else found.when(test, name)
    explicit = F.lower(V.text_at(v, "provider"))
    found = found.when(explicit.isin(S.PROVIDERS), explicit)
    github = [let(V.at(v, k), V.truthy) for k in ("workflow_run", "check_run", "workflow_job")]
    return (
        found.when(github[0] | github[1] | github[2], "github")
        .when(let(V.at(v, "object_kind"), V.truthy), "gitlab")
        .when(V.object_at(v, "build").isNotNull() & let(V.at(v, "name"), V.truthy), "jenkins")
        .when(V.text_at(v, "repository.full_name").isNotNull(), "github")
        .otherwise("manual")
    )


def detect_provider(deliveries: DataFrame) -> DataFrame:
    return (
        parsed(deliveries)
        .filter("payload IS NOT NULL")
        .select("delivery_id", provider_of("headers", F.col("payload")).alias("provider"))
    )


def extract_log_text(deliveries: DataFrame, *paths: str) -> DataFrame:
    return (
        parsed(deliveries)
        .filter("payload IS NOT NULL")
        .select(
            "delivery_id",
            F.coalesce(log_text(F.col("payload"), *paths), F.lit("")).alias("log_text"),
        )
    )


@once_per_context
def adapter(provider: str) -> tuple[Reader, Column]:
    reader = Reader(f"_{provider}")
    return reader, ADAPTERS[provider](reader)


def adapt(deliveries: DataFrame, provider: str) -> DataFrame:
    """Rows one adapter accepts, whatever the other adapters would say."""
    reader, fields = adapter(provider)
    rows = parsed(deliveries).filter("payload IS NOT NULL")
    read = once(rows, reader.values(F.lit(True)).alias(f"_{provider}"))
    return once(read, fields.alias("f")).filter("f IS NOT NULL").select("delivery_id", "f.*")


def dispatched(rows: DataFrame, usable: Column) -> DataFrame:
    """Adds ``detected``, the provider, and ``f``, the fields its adapter, or the manual one, found.

    A payload is read for the provider it is from and for the manual adapter.
    """
    rows = once(rows, F.when(usable, provider_of("headers", F.col("payload"))).alias("detected"))
    adapters = {name: adapter(name) for name in ADAPTERS}
    detected = F.col("detected")
    rows = once(rows, *[
        reader.values(detected.isNotNull() if name == "manual" else detected == name).alias(f"_{name}")
        for name, (reader, _) in adapters.items()
    ])
    own = reduce(
        lambda found, name: found.when(detected == name, adapters[name][1]),
        [n for n in ADAPTERS if n not in ("github", "manual")],
        F.when(detected == "github", adapters["github"][1]),
    )
    manual = F.when(detected.isNotNull(), adapters["manual"][1])
    return once(rows, F.coalesce(own, manual).alias("f"))


def normalise_deliveries(deliveries: DataFrame, query: str | None = None) -> DataFrame:
    """Every delivery with an ``outcome`` (accepted, ignored, rejected) and its failure fields.

    ``query`` names an optional map column with the request's query parameters.
    """
    v = F.col("payload")
    approval = F.coalesce(F.try_variant_get(v, "$.requireApproval", "boolean"), F.lit(False)) & (
        F.coalesce(V.kind(V.at(v, "requireApproval")), F.lit("")) == "BOOLEAN"
    )
    if query:
        q = F.col(query)
        approval = (
            approval
            | F.coalesce(q["requireApproval"] == "true", F.lit(False))
            | F.coalesce(q["approval"] == "1", F.lit(False))
        )
    fits = F.length("raw_body") <= S.BODY_CHARS
    checked = dispatched(parsed(deliveries), fits & v.isNotNull()).withColumn(
        "reason", F.when(~fits, "body is too long").otherwise(body_reason("raw_body", v))
    )
    outcome = (
        F.when(F.col("reason").isNotNull(), "rejected")
        .when(F.col("f").isNull(), "ignored")
        .otherwise("accepted")
    )
    fields = [F.col(f"f.{n}").alias(n) for n in INCOMING if n != "occurred_at"]
    return checked.select(
        "delivery_id",
        "received_at",
        outcome.alias("outcome"),
        "reason",
        "detected",
        *fields,
        F.coalesce("f.occurred_at", F.when(F.col("f").isNotNull(), F.col("received_at"))).alias("occurred_at"),
        F.coalesce(approval, F.lit(False)).alias("require_approval"),
    )


# ---- verification ------------------------------------------------------------
def hmac_sha256(body, secret: str) -> Column:
    """HMAC-SHA256 in hex, built from the digest expression."""
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    inner_digest = F.unhex(F.sha2(F.concat(inner, col(body).cast("binary")), 256))
    return F.sha2(F.concat(outer, inner_digest), 256)


def verify_deliveries(
    deliveries: DataFrame, secret: str | None, headers=tuple(SIGNATURE_HEADERS)
) -> DataFrame:
    """Add ``verified``. Without a secret every delivery passes.

    ``headers`` is the ordered list of accepted signature headers; a site with a
    header of its own passes its own list.
    """
    if not secret:
        return deliveries.select("delivery_id", F.lit(True).alias("verified"))
    given = F.coalesce(*[header("headers", h) for h in headers])
    hexed = F.lower(F.regexp_replace(trim(given), "(?i)^sha256=", ""))
    ok = hexed.rlike("^[0-9a-f]+$") & (hexed == hmac_sha256("raw_body", secret))
    return deliveries.select("delivery_id", F.coalesce(ok, F.lit(False)).alias("verified"))


def valid_ids(df: DataFrame, id_column: str = "id", repo_column: str = "repo") -> DataFrame:
    """Flags: the trimmed id is id-shaped, the trimmed repo is filled and not too long."""
    repo = filled(repo_column)
    return df.select(
        id_column,
        repo_column,
        F.coalesce(trim(id_column).rlike("^[A-Za-z0-9_-]{1,64}$"), F.lit(False)).alias("id_ok"),
        F.coalesce(F.length(repo) <= S.REPO_CHARS, F.lit(False)).alias("repo_ok"),
    )
