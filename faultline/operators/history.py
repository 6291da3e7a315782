"""Per-repository chat history: (repo, id, role, content, created_at)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline import schemas as S


def newest(messages: DataFrame, limit: int) -> DataFrame:
    """Newest messages of every repo. The rank filter is applied before the shuffle too."""
    limit = max(1, min(limit, S.HISTORY_MESSAGES))
    order = Window.partitionBy("repo").orderBy(F.desc("id"))
    return (
        messages.withColumn("age", F.row_number().over(order))
        .filter(F.col("age") <= limit)
        .drop("age")
    )


def trim_history(messages: DataFrame) -> DataFrame:
    cut = messages.withColumn("content", F.substring("content", 1, S.MESSAGE_CHARS))
    return newest(cut, S.HISTORY_MESSAGES)


def chat_history(messages: DataFrame, limit: int = S.HISTORY_MESSAGES) -> DataFrame:
    """Newest turns, to be read in id order; an unknown role counts as the user."""
    role = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    return newest(messages, limit).withColumn("role", role)


def clear_history(messages: DataFrame, repos: DataFrame) -> DataFrame:
    return messages.join(repos.select("repo"), "repo", "left_anti")
