"""Context blocks for a reviewer or a model, rendered as table jobs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.functions.text import cap, days_ago, fixed, let, one_line, present
from faultline.operators import history, stats

# ---- fixed values: block texts and limits -------------------------------------
PRIOR_OPEN = "=== PRIOR RESOLVED FAILURES (from this repo) ==="
PRIOR_CLOSE = "=== END PRIOR RESOLVED FAILURES ==="
PRIOR_NONE = (
    "(none — no similar past failure was retrieved; reason from the log alone and return "
    "citedFailureIds: [])"
)
PRIOR_NOTE = (
    "These were diagnosed and fixed before. Reuse a fix only if the problem genuinely matches."
)
NOT_RECORDED = "(not recorded)"
FLAKES_TITLE = "TOP REPEAT SIGNATURES (seen 3+ times in the window, most frequent first):"
MAX_SIMILAR, MAX_FLAKES, MAX_RECENT, MAX_TURNS = 4, 6, 8, 6
SIGNATURE_CHARS, EXCERPT_CHARS, SUMMARY_CHARS, QUESTION_CHARS = 600, 2000, 1200, 600
PRIOR_SIGNATURE, PRIOR_CAUSE, PRIOR_FIX, RECENT_CHARS, TURN_CHARS = 200, 260, 340, 160, 500


def text_lines(*parts) -> Column:
    out = []
    for i, part in enumerate(parts):
        out += [F.lit("\n")] * (i > 0) + [F.lit(part) if isinstance(part, str) else part]
    return F.concat(*out)


def prior_entry(now_ms: int) -> Column:
    def or_missing(text):
        return F.coalesce(let(text, present), F.lit(NOT_RECORDED))

    fix = F.coalesce("resolution_note", "suggested_fix")
    return text_lines(
        F.concat(F.lit("--- id: "), F.col("id")),
        F.concat(
            F.lit("similarity: "), fixed("score", 3), F.lit(" | status: "), F.col("status"),
            F.lit(" | seen: "), days_ago("last_seen_at", now_ms),
            F.lit(" | occurrences: "), F.col("occurrence_count").cast("string"),
        ),
        F.concat(F.lit("signature: "), one_line("signature_text", PRIOR_SIGNATURE)),
        F.concat(F.lit("root cause: "), or_missing(one_line("root_cause", PRIOR_CAUSE))),
        F.concat(F.lit("fix that worked: "), or_missing(one_line(fix, PRIOR_FIX))),
    )


def trim_neighbours(neighbours: DataFrame) -> DataFrame:
    return neighbours.withColumn(
        "excerpt", F.substring("excerpt", 1, S.NEIGHBOUR_EXCERPT_CHARS)
    )


def prior_blocks(targets: DataFrame, neighbours: DataFrame, now_ms: int) -> DataFrame:
    """One memory block per target failure_id.

    ``neighbours`` holds query_id, rank and the neighbour's failure columns; the
    best four of a target are gathered, so a group has at most four rows.
    """
    entry = F.struct("rank", prior_entry(now_ms).alias("text"))
    near = neighbours.filter(F.col("rank") <= MAX_SIMILAR)
    blocks = near.groupBy(F.col("query_id").alias("failure_id")).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["text"]), "\n"
        ).alias("entries")
    )
    some = text_lines(PRIOR_OPEN, PRIOR_NOTE, F.col("entries"), PRIOR_CLOSE)
    none = F.lit("\n".join([PRIOR_OPEN, PRIOR_NONE, PRIOR_CLOSE]))
    return (
        targets.select("failure_id")
        .join(blocks, "failure_id", "left")
        .select("failure_id", F.coalesce(some, none).alias("prior_block"))
    )


def triage_contexts(signatures: DataFrame, blocks: DataFrame) -> DataFrame:
    """User context per failure: (failure_id, category, confidence, file_hint, text, excerpt)."""
    context = text_lines(
        "=== FAILING JOB ===",
        F.concat(F.lit("category: "), F.col("category")),
        F.concat(F.lit("parser confidence: "), fixed("confidence", 2)),
        F.concat(
            F.lit("implicated file/test: "), F.coalesce(present("file_hint"), F.lit("unknown"))
        ),
        "", "normalised signature:", cap("text", SIGNATURE_CHARS),
        "", "log excerpt:", cap("excerpt", EXCERPT_CHARS),
        "", F.col("prior_block"),
        "", "Return the JSON object now.",
    )
    return signatures.join(blocks, "failure_id").select("failure_id", context.alias("context"))


TRIAGE_RULES = "\n".join([
    "You triage one failed job of a build pipeline. Use the evidence you are given and nothing else.",
    "",
    "Settle four things:",
    "1. Defect or flake. A defect needs a change by a person: to code, configuration or a dependency.",
    "   A flake comes from the machine, the network or a race in the test harness and would pass if run",
    "   again. A cause you do not know is no reason to call it a flake.",
    "2. The root cause, in two sentences at most, with the file, symbol, package, version or limit",
    "   that the log points to.",
    "3. A fix that can be carried out now: a command, a changed line, a pinned version, a raised limit.",
    "   Looking further into it is not a fix.",
    "4. Earlier failures. If the block of prior failures holds the same problem, take over its fix, say so",
    "   in the root cause and cite its id. Cite ids of that block only; without a match cite none.",
    "",
    "Answer with one JSON object and no other text. It has all of these keys, none of them null:",
    '{"rootCause": text, "suggestedFix": text, "confidence": number from 0 to 1, "isLikelyFlake": boolean,',
    ' "headline": text, "citedFailureIds": list of ids}',
    "Confidence is 0.8 or more only where the log names the cause, 0.3 to 0.6 where you infer it, and below",
    "0.3 where the log says little.",
])


def triage_messages(contexts: DataFrame) -> DataFrame:
    """(failure_id, position, role, content): the rules, then the context of ``triage_contexts``."""
    message = [
        F.struct(F.lit(0).alias("position"), F.lit("system").alias("role"), F.lit(TRIAGE_RULES).alias("content")),
        F.struct(F.lit(1).alias("position"), F.lit("user").alias("role"), F.col("context").alias("content")),
    ]
    return contexts.select("failure_id", F.inline(F.array(*message)))


def recent_blocks(failures: DataFrame, now_ms: int) -> DataFrame:
    """Newest eight failures of each repo as text."""
    order = Window.partitionBy("repo").orderBy(F.desc("last_seen_at"), "id")
    line = F.concat(
        F.lit("  - id="), F.col("id"), F.lit(" | "), F.col("status"), F.lit(" | "), F.col("category"),
        F.lit(" | "), F.coalesce(present("branch"), F.lit("unknown-branch")), F.lit(" | "),
        days_ago("last_seen_at", now_ms), F.lit(" | x"), F.col("occurrence_count").cast("string"),
        F.lit(" | "), one_line("signature_text", RECENT_CHARS),
    )
    newest = (
        failures.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= MAX_RECENT)
        .select("repo", F.struct("rank", line.alias("text")).alias("e"))
    )
    listed = F.transform(F.sort_array(F.collect_list("e")), lambda e: e["text"])
    return newest.groupBy("repo").agg(
        F.concat(F.lit("RECENT FAILURES (newest first):\n"), F.array_join(listed, "\n")).alias("recent")
    )


def stats_block(repo, days: int) -> Column:
    def flake_line(f):
        return F.concat(
            F.lit("  - "), f["count"].cast("string"), F.lit("x ["), F.substring(f["signature_hash"], 1, 8),
            F.lit("] "), one_line(f["signature_text"], RECENT_CHARS),
        )

    flakes = F.array_join(
        F.transform(F.slice(F.col("top_flakes"), 1, MAX_FLAKES), flake_line), "\n"
    )
    return text_lines(
        F.concat(F.lit("repo: "), repo),
        f"window: last {days} days",
        F.concat(F.lit("open failures: "), F.coalesce("open_count", F.lit(0)).cast("string")),
        F.concat(F.lit("resolved failures: "), F.coalesce("resolved_count", F.lit(0)).cast("string")),
        "", FLAKES_TITLE,
        F.coalesce(let(flakes, present), F.lit("  (none)")),
    )


def repo_contexts(failures: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """Statistics and recent failures of every repo as one text."""
    summary = stats.repo_stats(failures, now_ms, days)
    joined = recent_blocks(failures, now_ms).join(summary, "repo", "left")
    text = text_lines(stats_block(F.col("repo"), days), "", F.col("recent"))
    return joined.select("repo", text.alias("context"))


def assistant_rules(repo, assistant: str) -> Column:
    return F.concat(
        F.lit(f"{assistant}, answering for the repository "), repo,
        F.lit(". Use only the facts between the context markers and say what is missing."),
    )


def chat_messages(
    questions: DataFrame, contexts: DataFrame, messages: DataFrame, assistant: str = "CI assistant"
) -> DataFrame:
    """(repo, position, role, content): rules, the last turns, then context and question.

    At most six turns per repo survive the rank filter, so no repo's history is
    gathered. Position 0 is the rules, 1..6 the turns, 7 the question.
    """
    asked = questions.select("repo", "question")
    turns = history.chat_history(messages, MAX_TURNS).join(asked.select("repo"), "repo", "left_semi")
    order = Window.partitionBy("repo").orderBy("id")
    numbered = turns.select(
        "repo", F.row_number().over(order).alias("position"), "role",
        one_line("content", TURN_CHARS).alias("content"),
    ).filter("content <> ''")
    rules = asked.select(
        "repo", F.lit(0).alias("position"), F.lit("system").alias("role"),
        assistant_rules(F.col("repo"), assistant).alias("content"),
    )
    prompt = text_lines(
        "=== CONTEXT ===",
        F.coalesce("context", F.lit("RECENT FAILURES:\n  (none recorded)")),
        "=== END CONTEXT ===", "",
        F.concat(F.lit("Question: "), one_line("question", QUESTION_CHARS)),
    )
    final = asked.join(contexts, "repo", "left").select(
        "repo", F.lit(MAX_TURNS + 1).alias("position"), F.lit("user").alias("role"),
        prompt.alias("content"),
    )
    return rules.unionByName(numbered).unionByName(final)


def summary_inputs(df: DataFrame, excerpt: str = "excerpt") -> DataFrame:
    text = F.coalesce(let(cap(excerpt, SUMMARY_CHARS), present), F.lit("(empty log)"))
    return df.withColumn("summary_input", text)
