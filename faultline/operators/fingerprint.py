"""Fingerprint operators over a table of logs: (log_id, log_text)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import signature as sig
from faultline.functions.reuse import once, once_per_context
from faultline.functions.text import let


def fingerprint_logs(logs: DataFrame, text: str = "log_text", keep=("log_id",)) -> DataFrame:
    """Signature columns for every log. Narrow: no shuffle, valid on a stream."""
    return logs.select(*keep, sig.fingerprint(text).alias("s")).select(*keep, "s.*")


@once_per_context
def detected(log: str) -> Column:
    return let(sig.tail_lines(log), sig.detect)


@once_per_context
def undetected(log: str) -> Column:
    return let(sig.tail_lines(log), sig.fallback_signature)


def log_tail(logs: DataFrame, lines: int | None = None, chars: int | None = None) -> DataFrame:
    size = {}
    if lines is not None:
        size["lines"] = lines
    if chars is not None:
        size["chars"] = chars
    return logs.select("log_id", sig.tail_lines("log_text", **size).alias("lines"))


def exploded_lines(logs: DataFrame) -> DataFrame:
    """One row per tail line: (log_id, i, line)."""
    return logs.select("log_id", F.posexplode(sig.tail_lines("log_text")).alias("i", "line"))


def normalise_lines(lines: DataFrame) -> DataFrame:
    """Adds ``normalised``, which a filter behind it uses again without computing it again."""
    return once(lines, sig.normalise("line").alias("normalised"))


def drop_noise_lines(normalised: DataFrame) -> DataFrame:
    return normalised.filter((F.col("normalised") != "") & ~sig.is_noise("normalised"))


def prescreen_lines(logs: DataFrame) -> DataFrame:
    """The newest lines of each log worth classifying: (log_id, i, line)."""
    found = let(
        sig.tail_lines("log_text"),
        lambda lines: F.transform(
            sig.candidate_positions(lines),
            lambda i: F.struct(i.alias("i"), F.get(lines, i).alias("line")),
        ),
    )
    return logs.select("log_id", F.inline(found))


def classify_logs(logs: DataFrame) -> DataFrame:
    """Winning rule per log; logs without one are absent."""
    found = logs.select("log_id", detected("log_text").alias("hit")).filter("hit IS NOT NULL")
    return found.select(
        "log_id",
        (-F.col("hit.newest")).alias("line_index"),
        F.col("hit.priority").alias("priority"),
        sig.rule_value(F.col("hit.rule"), 0).alias("category"),
        sig.rule_value(F.col("hit.rule"), 2).alias("confidence"),
    )


def fallback_signatures(logs: DataFrame) -> DataFrame:
    """Signature of logs in which no rule fires, whatever the rules say about them."""
    return logs.select("log_id", undetected("log_text").alias("s")).select("log_id", "s.*")
