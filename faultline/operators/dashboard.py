"""Derived columns of the failure feed."""

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.functions import variants as V
from faultline.functions.text import col, let, present, trim

# ---- fixed values --------------------------------------------------------------
CATEGORY_LABELS = {
    "test_failure": "test", "compile_error": "compile", "dependency_error": "deps",
    "infra_timeout": "infra", "oom": "oom", "lint_error": "lint", "permission_error": "perms",
    "network_error": "network", "unknown": "unknown",
}
STATUS_LABELS = {
    "open": "open", "awaiting_approval": "awaiting you", "triaged": "triaged",
    "resolved": "resolved", "dismissed": "dismissed",
}
RESULT_KEYS = ["rootCause", "suggestedFix", "confidence", "headline"]


def merged_triage(failures: DataFrame, runs: DataFrame) -> DataFrame:
    """Triage result of each failure: its own columns, else the first value in its audit details.

    The audit side is one aggregate per key over (created_at, id), so details of
    one failure merge before the shuffle.
    """
    details = runs.filter(trim("detail").startswith("{")).select(
        "failure_id", F.struct("created_at", "id").alias("o"),
        F.explode(F.array(V.parse_object("detail"))).alias("v"),
    ).filter("v IS NOT NULL")

    def non_null(key):
        # a JSON text is comparable and groupable, a variant is not
        return let(V.first_value(F.col("v"), key), lambda x: F.to_json(x))

    typed = details.select("failure_id", "o", *[non_null(k).alias(k) for k in RESULT_KEYS])
    found = typed.groupBy(F.col("failure_id").alias("id")).agg(
        *[F.min_by(k, F.when(F.col(k).isNotNull(), F.col("o"))).alias(f"run_{k}") for k in RESULT_KEYS]
    )

    def run_text(key):
        text = let(V.parse(F.col(f"run_{key}")), lambda v: F.when(V.is_string(v), V.as_string(v)))
        return let(text, present)

    def run_number(key):
        return let(V.parse(F.col(f"run_{key}")), lambda v: F.when(V.is_number(v), V.as_double(v)))

    cited = F.filter(
        F.col("cited_failure_ids"), lambda x: (x != "") & (x != F.col("id"))
    )
    return failures.join(found, "id", "left").select(
        "id",
        F.coalesce(present("root_cause"), run_text("rootCause")).alias("root_cause"),
        F.coalesce(present("suggested_fix"), run_text("suggestedFix")).alias("suggested_fix"),
        F.coalesce("confidence", run_number("confidence")).alias("confidence"),
        F.col("is_likely_flake").alias("is_likely_flake"),
        F.slice(cited, 1, S.CITED_LIMIT).alias("cited_failure_ids"),
        F.coalesce("headline", run_text("headline")).alias("headline"),
    )


def feed_summary(failures: DataFrame) -> DataFrame:
    """Per repo: rows shown, rows awaiting a decision, rows seen more than twice."""
    return failures.groupBy("repo").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "awaiting_approval").alias("awaiting"),
        F.count_if(F.col("occurrence_count") > 2).alias("hot"),
    )


def next_actions(failures: DataFrame) -> DataFrame:
    status = F.col("status")
    explained = F.coalesce(F.col("root_cause"), F.lit("")) != ""
    action = F.when(status == "awaiting_approval", "approve").when(
        (status == "triaged") | ((status == "open") & explained), "resolve"
    )
    return failures.withColumn("next_action", action)


def confidence_band(value) -> Column:
    share = col(value)
    return F.when(share >= 0.75, "high").when(share >= 0.45, "mid").when(share.isNotNull(), "low")


def confidence_bands(failures: DataFrame) -> DataFrame:
    return failures.withColumn("band", confidence_band("confidence"))


def label(value, labels: dict) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(labels.items())])
    return F.coalesce(F.try_element_at(table, col(value)), present(value), F.lit("unknown"))


def labelled_failures(failures: DataFrame) -> DataFrame:
    return failures.withColumn("category_label", label("category", CATEGORY_LABELS)).withColumn(
        "status_label", label("status", STATUS_LABELS)
    )


def repo_picker(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.select("repo").union(known.select("repo")).distinct().orderBy("repo")
