"""Session transcripts: one JSON object per line, ordered by (session, line_no)."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import patterns as P
from faultline.functions import variants as V
from faultline.functions.ordering import with_row_numbers
from faultline.functions.text import col, filled, let, trim


def redact(text) -> Column:
    """Text without credentials, applied in pattern order."""
    return reduce(lambda s, rule: F.regexp_replace(s, rule[0], rule[1]), P.REDACTIONS, col(text))


def redact_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, redact(text))


def scan_transcripts(lines: DataFrame) -> DataFrame:
    """Parsed rows; blank and unparseable lines are skipped."""
    return (
        lines.filter(trim("line") != "")
        .select("*", F.explode(F.array(V.parse("line"))).alias("row"))
        .filter("row IS NOT NULL")
    )


def is_type(value, name: str) -> Column:
    return F.coalesce(V.as_string(V.at(value, "type")) == name, F.lit(False))


def prompt_text(row) -> Column:
    """Text typed by a person in one transcript row, or null."""

    def from_content(c):
        blocks = F.filter(V.elements(c), lambda b: is_type(b, "text"))
        joined = F.array_join(
            F.transform(blocks, lambda b: F.coalesce(V.as_string(V.at(b, "text")), F.lit(""))), "\n"
        )
        text = F.when(V.is_string(c), V.as_string(c)).when(V.is_array(c), joined)
        return let(filled(text), lambda t: F.when(~starts_with_any(t), t))

    def starts_with_any(t):
        return reduce(lambda a, b: a | b, [t.startswith(p) for p in P.SKIPPED_PROMPT_PREFIXES])

    content = V.at(row, "message.content")
    return F.when(is_type(row, "user"), let(content, from_content))


def human_prompts(rows: DataFrame) -> DataFrame:
    """(session, line_no, text) of the prompts people typed."""
    out = rows.select("session", "line_no", F.explode(F.array(prompt_text(F.col("row")))).alias("text"))
    return out.filter("text IS NOT NULL")


def briefs(row) -> Column:
    def is_brief(b):
        prompt = V.at(V.at(b, "input"), "prompt")
        return is_type(b, "tool_use") & F.coalesce(V.as_string(V.at(b, "name")) == "Agent", F.lit(False)) & let(prompt, V.truthy)

    def brief(b):
        given = V.at(b, "input")
        return F.struct(
            F.coalesce(V.as_string(V.at(given, "description")), F.lit("agent")).alias("label"),
            V.as_string(V.at(given, "prompt")).alias("text"),
        )

    found = F.transform(F.filter(V.elements(V.at(row, "message.content")), is_brief), brief)
    return F.when(is_type(row, "assistant"), found)


def agent_briefs(rows: DataFrame) -> DataFrame:
    """(session, line_no, position, label, text) of delegated work."""
    return rows.select(
        "session", "line_no", F.posexplode(briefs(F.col("row"))).alias("position", "b")
    ).select("session", "line_no", "position", "b.*")


def prompt_entries(lines: DataFrame) -> DataFrame:
    rows = scan_transcripts(lines)
    human = human_prompts(rows).select(
        "session", "line_no", F.lit(-1).alias("position"), F.lit("human").alias("kind"),
        F.lit(None).cast("string").alias("label"), "text",
    )
    agent = agent_briefs(rows).select(
        "session", "line_no", "position", F.lit("agent").alias("kind"), "label", "text"
    )
    return human.unionByName(agent)


ORDER = ["session", "line_no", "position"]


def export_prompts(lines: DataFrame) -> DataFrame:
    """Numbered, redacted report entries: (number, heading, text)."""
    numbered = with_row_numbers(prompt_entries(lines), ORDER, "number")
    what = F.when(F.col("kind") == "human", "Developer prompt").otherwise(
        F.concat(F.lit("Sub-agent brief — "), F.col("label"))
    )
    heading = F.concat(F.lit("## "), F.col("number").cast("string"), F.lit(". "), what)
    return numbered.select("number", "kind", heading.alias("heading"), redact("text").alias("text"))


def prompt_totals(lines: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return prompt_entries(lines).agg(
        F.count("*").alias("recorded"),
        F.count_if(kind == "human").alias("human"),
        F.count_if(kind == "agent").alias("agent"),
    )
