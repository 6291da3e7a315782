"""Reports over the failures table, for all repositories in one plan."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline import schemas as S


def in_window(failures: DataFrame, now_ms: int, days: int) -> DataFrame:
    days = max(1, min(days, 365))
    return failures.filter(F.col("last_seen_at") >= now_ms - days * S.DAY_MS)


def status_counts() -> list:
    status = F.col("status")
    return [
        F.count_if(status.isin(S.OPEN_STATUSES)).alias("open_count"),
        F.count_if(status == "resolved").alias("resolved_count"),
    ]


def repo_counts(failures: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    return in_window(failures, now_ms, days).groupBy("repo").agg(*status_counts())


def top_flakes(
    failures: DataFrame, now_ms: int, days: int = 7, limit: int = S.TOP_FLAKES
) -> DataFrame:
    """Most repeated signatures of every repo: (repo, signature_hash, signature_text, count, rank)."""
    # a hash names one text, so counting per text first costs no extra groups and
    # keeps the large aggregate numeric, which Spark runs in hash maps
    per_text = (
        in_window(failures, now_ms, days)
        .groupBy("repo", "signature_hash", "signature_text")
        .agg(F.sum("occurrence_count").alias("count"), F.max("last_seen_at").alias("seen"))
    )
    return ranked_flakes(per_text, limit)


def ranked_flakes(per_text: DataFrame, limit: int = S.TOP_FLAKES) -> DataFrame:
    """The flakes of every repo from counts per text, in any number of parts."""
    per_signature = (
        per_text.groupBy("repo", "signature_hash")
        .agg(
            F.min("signature_text").alias("signature_text"),
            F.sum("count").alias("count"),
            F.max("seen").alias("seen"),
        )
        .filter(F.col("count") >= S.FLAKE_MIN)
    )
    order = Window.partitionBy("repo").orderBy(F.desc("count"), F.desc("seen"), "signature_hash")
    return (
        per_signature.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("repo", "signature_hash", "signature_text", "count", "rank")
    )


def repo_stats(failures: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """Counts and the flake list (at most ten entries) of every repo seen in the window."""
    flake = F.struct("rank", "signature_hash", "signature_text", "count")
    flakes = (
        top_flakes(failures, now_ms, days)
        .groupBy("repo")
        .agg(F.sort_array(F.collect_list(flake)).alias("top_flakes"))
    )
    empty = F.array().cast("array<struct<rank:int,signature_hash:string,signature_text:string,count:bigint>>")
    return (
        repo_counts(failures, now_ms, days)
        .join(flakes, "repo", "left")
        .withColumn("top_flakes", F.coalesce("top_flakes", empty))
        .withColumn("window_days", F.lit(max(1, min(days, 365))))
    )


def flake_evidence(failures: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """Every failure with the repeat count of its signature, when it is a top flake."""
    flakes = top_flakes(failures, now_ms, days).select(
        "repo", "signature_hash", F.col("count").alias("flake_count")
    )
    return failures.join(flakes, ["repo", "signature_hash"], "left")


def repo_counters(failures: DataFrame, claims: DataFrame, now_ms: int) -> DataFrame:
    """Running totals per repo; ``claims`` is the current claim of every signature."""
    totals = failures.groupBy("repo").agg(
        F.count("*").alias("total_failures"),
        F.count_if(F.col("status") == "resolved").alias("total_resolved"),
        F.max("created_at").alias("last_failure_at"),
    )
    live = F.col("completed_at").isNull() & (F.col("claimed_at") >= now_ms - S.STALE_CLAIM_MS)
    running = claims.groupBy("repo").agg(F.count_if(live).alias("in_flight"))
    return totals.join(running, "repo", "left").withColumn(
        "in_flight", F.coalesce("in_flight", F.lit(0))
    )
