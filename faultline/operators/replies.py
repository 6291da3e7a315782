"""Free-form model replies to typed triage rows. No model is called."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.functions import variants as V
from faultline.functions.reuse import once
from faultline.functions.text import clip, col, collapse_spaces, filled, let, present, trim

# ---- fixed values: key aliases, sentences and limits -------------------------
ROOT_CAUSE_KEYS = ["rootCause", "root_cause", "cause", "analysis"]
FIX_KEYS = ["suggestedFix", "suggested_fix", "fix", "remediation"]
HEADLINE_KEYS = ["headline", "title", "summary"]
CITED_KEYS = ["citedFailureIds", "cited_failure_ids", "citations", "citedIds"]
CONFIDENCE_KEYS = ["confidence", "confidenceScore", "confidence_score"]
FLAKE_KEYS = ["isLikelyFlake", "is_likely_flake", "likelyFlake", "flake"]
NO_CAUSE = "The model did not identify a specific root cause from the supplied log."
NO_FIX = (
    "No concrete fix was produced. Re-run the job to test for flakiness, then inspect the full log."
)
UNPARSED_CAUSE = "Unstructured model output (JSON parsing failed): "
NO_OUTPUT = "The reasoning model returned no usable output for this failure."
UNPARSED_FIX = (
    "Automated triage could not produce structured output. Review the log excerpt manually, "
    "then re-run triage."
)
NO_ANSWER = (
    "I could not generate an answer for that. Try asking about recent failures or flaky tests "
    "in this repo."
)
CAUSE_CHARS, FIX_CHARS, HEADLINE_CHARS, PROSE_CHARS = 1200, 2000, 120, 1000
FENCE = r"(?s)```(?:json|JSON)?\s*(.*?)```"
OPEN_FENCE = r"(?i)^```(?:json)?\s*"
CLOSE_FENCE = r"```\s*$"


# ---- reply text --------------------------------------------------------------
def response_text(response) -> Column:
    """Text of a recorded response: JSON string, response text or object, or first choice."""

    def non_blank(x):
        return F.when(V.is_string(x) & (trim(V.as_string(x)) != ""), V.as_string(x))

    def pick(v):
        direct = V.at(v, "response")
        choice = F.try_variant_get(v, "$.choices[0].message.content", "variant")
        return F.when(V.is_string(v), V.as_string(v)).when(
            V.is_object(v),
            F.coalesce(
                let(direct, non_blank),
                let(direct, lambda d: F.when(V.is_object(d) | V.is_array(d), F.to_json(d))),
                let(choice, non_blank),
            ),
        )

    return F.coalesce(let(V.parse(col(response)), pick), F.lit(""))


def reply_text(df: DataFrame, response: str = "response") -> DataFrame:
    return df.withColumn("reply_text", response_text(response))


def strip_fences(reply) -> Column:
    """Reply without the Markdown fences around it."""

    def inner(text):
        return let(
            trim(F.regexp_extract(text, FENCE, 1)),
            lambda x: F.when(text.rlike(FENCE) & (F.regexp_extract(text, FENCE, 1) != ""), x).otherwise(text),
        )

    body = let(trim(F.coalesce(col(reply), F.lit(""))), inner)
    return trim(F.regexp_replace(F.regexp_replace(body, OPEN_FENCE, ""), CLOSE_FENCE, ""))


PIECE = r'(?s)[^"{}\\]*["{}\\]'  # plain characters and the structural one behind them
SCAN = "struct<depth:int,quoted:boolean,escaped:boolean,at:int,start:int,spans:array<struct<start:int,size:int>>>"


def balanced(text) -> Column:
    """Outermost brace-balanced spans of a text; braces inside JSON strings do not count.

    One pass over the structural characters, each with the plain ones in front of it.
    Quotes count inside braces only, backslashes inside strings only; a brace or string
    that never closes ends the scan.
    """

    def step(state, piece):
        size = F.length(piece)
        mark, at = F.right(piece, F.lit(1)), state["at"] + size
        quoted, inside = state["quoted"], state["depth"] > 0
        literal = quoted & state["escaped"] & (size == 1)  # the backslash was right in front
        quote = (mark == '"') & ~literal & inside
        opens, closes = ~quoted & (mark == "{"), ~quoted & inside & (mark == "}")
        depth = state["depth"] + opens.cast("int") - closes.cast("int")
        ended = closes & (depth == 0)
        span = F.struct(state["start"].alias("start"), (at - state["start"]).alias("size"))
        return F.struct(
            depth.alias("depth"),
            (quoted != quote).alias("quoted"),
            (quoted & (mark == "\\") & ~literal).alias("escaped"),
            at.alias("at"),
            F.when(opens & ~inside, at - 1).otherwise(state["start"]).alias("start"),
            F.when(ended, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        ).cast(SCAN)

    begin = F.struct(
        F.lit(0), F.lit(False), F.lit(False), F.lit(0), F.lit(0), F.array().cast("array<struct<start:int,size:int>>")
    ).cast(SCAN)
    return let(
        col(text),
        lambda t: F.transform(
            F.aggregate(F.regexp_extract_all(t, F.lit(PIECE), F.lit(0)), begin, step)["spans"],
            lambda s: F.substring(t, s["start"] + 1, s["size"]),
        ),
    )


def extract_reply_json(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add ``object``: the JSON object text a reply carries, or null.

    The whole text is tried first; only replies that are not one clean object are
    scanned for balanced spans.
    """
    whole = V.parse_object("body")
    spans = F.when(F.col("clean").isNull() & F.col("body").contains("{"), F.col("body"))
    good = F.filter(F.col("spans"), lambda s: V.parse_object(s).isNotNull())

    def best(found):
        def is_triage(s):
            return let(
                V.parse(s),
                lambda v: V.at(v, "rootCause").isNotNull() | V.at(v, "root_cause").isNotNull(),
            )

        return F.coalesce(
            F.get(F.filter(found, is_triage), F.lit(0)), F.get(found, F.lit(0))
        )

    return (
        df.select("*", F.explode(F.array(strip_fences(reply))).alias("body"))
        .withColumn("clean", F.when(whole.isNotNull(), F.col("body")))
        .withColumn("spans", F.when(spans.isNotNull(), balanced(spans)))
        .withColumn("object", F.coalesce("clean", let(good, best)))
        .drop("body", "clean", "spans")
    )


# ---- coercion ----------------------------------------------------------------
def loose_text(x) -> Column:
    """Text of a JSON value: strings trimmed, scalars printed, string lists joined."""
    joined = F.array_join(F.transform(F.filter(V.elements(x), V.is_string), V.as_string), " ")
    return (
        F.when(V.is_string(x), trim(V.as_string(x)))
        .when(V.is_number(x), V.number_text(x))
        .when(V.kind(x) == "BOOLEAN", V.as_string(x))
        .when(V.is_array(x), trim(joined))
    )


def as_confidence(x, fallback: float = 0.5) -> Column:
    """Number, numeric text or percentage, brought into 0..1."""

    def from_text(s):
        number = F.regexp_extract(
            F.regexp_replace(s, "%", ""), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1
        ).try_cast("double")
        return F.when(s.contains("%"), number / 100).otherwise(number)

    def bounded(n):
        share = F.when((n > 1) & (n <= 100), n / 100).otherwise(n)
        ok = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
        return F.when(ok, F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).otherwise(fallback)

    number = F.when(V.is_number(x), V.as_double(x)).when(V.is_string(x), from_text(V.as_string(x)))
    return let(number, bounded)


def as_flake(x, category) -> Column:
    """Yes or no; otherwise what the category suggests."""
    word = F.lower(trim(V.as_string(x)))
    return F.coalesce(
        F.when(V.kind(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
        .when(V.is_string(x) & word.isin("true", "yes"), True)
        .when(V.is_string(x) & word.isin("false", "no"), False)
        .when(V.is_number(x), V.as_double(x) != 0),
        col(category).isin(S.FLAKY_CATEGORIES),
    )


def as_cited(x, allowed) -> Column:
    """Cited ids in cited order, once each, only ids that were offered."""
    listed = F.when(V.is_array(x), F.transform(V.elements(x), lambda e: let(e, loose_text))).when(
        V.is_string(x) & (trim(V.as_string(x)) != ""),
        F.transform(F.split(V.as_string(x), r"[\s,]+"), trim),
    )
    known = F.filter(listed, lambda i: (i != "") & F.array_contains(col(allowed), i))
    return F.coalesce(F.array_distinct(known), F.array().cast("array<string>"))


VALUES = {
    "_cause": ROOT_CAUSE_KEYS, "_fix": FIX_KEYS, "_headline": HEADLINE_KEYS, "_cited": CITED_KEYS,
    "_confidence": CONFIDENCE_KEYS, "_flake": FLAKE_KEYS,
}


def with_triage(df: DataFrame, object: str, category: str, allowed: str) -> DataFrame:
    """Adds ``t``, the typed triage of the object text in a column.

    Step by step over columns, so the plan stays flat: the parsed object, the values
    of its keys, the texts among them, the result.
    """
    value = F.col("_object")
    rows = once(df, V.parse_object(object).alias("_object"))
    rows = once(rows, *[V.first_value(value, *keys).alias(name) for name, keys in VALUES.items()])
    texts = ("_cause", "_fix", "_headline")
    rows = once(rows, *[loose_text(F.col(name)).alias(f"{name}_text") for name in texts])
    cause, fix, headline = (present(f"{name}_text") for name in texts)
    reason = F.coalesce(cause, F.lit(NO_CAUSE))
    return rows.withColumn("t", F.struct(
        clip(reason, CAUSE_CHARS).alias("root_cause"),
        clip(F.coalesce(fix, F.lit(NO_FIX)), FIX_CHARS).alias("suggested_fix"),
        as_confidence(F.col("_confidence")).alias("confidence"),
        as_flake(F.col("_flake"), category).alias("is_likely_flake"),
        as_cited(F.col("_cited"), allowed).alias("cited_failure_ids"),
        clip(F.coalesce(headline, reason), HEADLINE_CHARS).alias("headline"),
    ))


def fallback_struct(reply, category, signature_text) -> Column:
    headline = F.coalesce(
        let(collapse_spaces(col(signature_text)), present),
        F.concat(F.lit("Unparsed triage for "), col(category)),
    )
    cause = let(
        strip_fences(reply),
        lambda t: F.when(t != "", F.concat(F.lit(UNPARSED_CAUSE), clip(t, PROSE_CHARS))).otherwise(NO_OUTPUT),
    )
    return F.struct(
        cause.alias("root_cause"),
        F.lit(UNPARSED_FIX).alias("suggested_fix"),
        F.lit(0.1).alias("confidence"),
        col(category).isin(S.FLAKY_CATEGORIES).alias("is_likely_flake"),
        F.array().cast("array<string>").alias("cited_failure_ids"),
        clip(headline, HEADLINE_CHARS).alias("headline"),
    )


def coerce_triage(
    df: DataFrame, keep=("failure_id",), object: str = "object", category: str = "category",
    allowed: str = "allowed",
) -> DataFrame:
    """Typed triage columns from parsed replies; ``allowed`` lists the ids that may be cited."""
    rows = with_triage(df, object, category, allowed)
    return once(rows.drop(*VALUES, "_object"), F.col("t").alias("_t")).select(*keep, "_t.*")


def fallback_triage(df: DataFrame, keep=("failure_id",), reply: str = "reply") -> DataFrame:
    out = fallback_struct(reply, "category", "signature_text")
    return df.select(*keep, F.explode(F.array(out)).alias("t")).select(*keep, "t.*")


def first_valid_reply(replies: DataFrame, attempts: int = 2) -> DataFrame:
    """Per failure: the object of the earliest reply that has one, and the last reply text."""
    tried = extract_reply_json(replies.filter(F.col("attempt") < attempts))
    order = F.when(F.col("object").isNotNull(), F.col("attempt"))
    return tried.groupBy("failure_id").agg(
        F.min_by("object", order).alias("object"),
        F.min(order).alias("attempt"),
        F.max_by("reply", "attempt").alias("last_reply"),
    )


def triage_from_replies(replies: DataFrame, signatures: DataFrame) -> DataFrame:
    """One triage row per failure; ``signatures`` holds failure_id, category, signature_text, allowed."""
    chosen = first_valid_reply(replies).join(signatures, "failure_id")
    typed = with_triage(chosen, "object", "category", "allowed")
    plain = fallback_struct("last_reply", "category", "signature_text")
    result = F.when(F.col("object").isNotNull(), F.col("t")).otherwise(plain)
    return once(typed, result.alias("_t")).select("failure_id", "_t.*")


def clean_summary(text) -> Column:
    bare = F.regexp_replace(col(text), "^[\"']|[\"']$", "")
    return let(collapse_spaces(bare), lambda t: clip(t, HEADLINE_CHARS))


def clean_summaries(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("summary", clean_summary(text))


# ---- recorded answer streams --------------------------------------------------
def frame_token(line, key: str = "response") -> Column:
    """Text carried by one event-stream line, or null."""

    def token(v):
        return let(
            V.at(v, key),
            lambda x: F.when(V.is_string(x), V.as_string(x))
            .when(V.is_number(x), V.number_text(x))
            .when(V.kind(x) == "BOOLEAN", V.as_string(x)),
        )

    def from_payload(p):
        return F.when((p != "") & (p != "[DONE]"), let(V.parse(p), token))

    data = F.when(col(line).startswith("data:"), trim(F.substring(col(line), 6, 2**31 - 1)))
    return let(let(data, from_payload), present)


def ordered_text(df: DataFrame, keys, order, piece) -> DataFrame:
    entry = F.struct(F.col(order).alias("o"), F.col(piece).alias("p"))
    parts = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["p"])
    return df.groupBy(*keys).agg(F.array_join(parts, "").alias(piece))


def reassemble_answers(frames: DataFrame, chunk: int = 1024) -> DataFrame:
    """Answer text of every recorded stream (stream_id, seq, line).

    Pieces are joined per chunk of the sequence first, so no task sorts a whole
    stream of small frames; the second step handles one text per chunk.
    """
    tokens = frames.select("stream_id", "seq", frame_token("line").alias("answer"))
    pieces = tokens.filter("answer IS NOT NULL").withColumn("part", F.floor(F.col("seq") / chunk))
    chunks = ordered_text(pieces, ["stream_id", "part"], "seq", "answer")
    answers = ordered_text(chunks, ["stream_id"], "part", "answer")
    streams = frames.select("stream_id").distinct()
    return streams.join(answers, "stream_id", "left").withColumn(
        "answer", F.coalesce("answer", F.lit(NO_ANSWER))
    )
