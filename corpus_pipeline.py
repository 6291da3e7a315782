"""The corpus pipeline: language, line dedup, near duplicates, mixing, tokens.

Every stage reads what the one before has written as Parquet in the shared folder of
``spark.checkpoint.dir``, works on all of it and returns the columns of documents;
the last one adds the token ids.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import language, linededup, mixing, ngramjoin, tokens
from faultline.sources.checkpoints import checkpoint_dir

CLEAR = 0.35  # the least score among four languages; four equal chances have 0.25


def clear_score(languages: int) -> float:
    """The mark for a number of languages: as far above equal chances, by odds, as ``CLEAR`` among four."""
    if languages < 2:
        return 0.0
    odds = 3 * CLEAR / (1 - CLEAR) / (languages - 1)
    return odds / (1 + odds)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or without a clear language, go.

    Without labels to learn from no language is unclear: every text with a letter stays.
    """
    network = language.learn(docs)
    if network is None:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    held = docs.select(F.struct("*").alias("_row"), "text")
    named = language.identified(held, network, "_language")
    least = clear_score(len(network.languages))
    clear = (F.col("_language.lang_pred") != language.UNKNOWN) & (F.col("_language.score") >= least)
    return named.filter(clear).select("_row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go, and the documents that have nothing else."""
    return linededup.remaining(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates stays, that with the smallest id, null ids last.

    Rows equal in id and text are one document; texts that are null or without a word stay.
    """
    return ngramjoin.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a divided one with the words taken.

    A null source is a source of its own; texts that are null or without a word have
    nothing to take and go.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text; the text is what they decode to.

    Adds ``n_tokens`` and ``token_ids``; columns of the documents with these names give
    way to them. A null text becomes an empty one without ids.
    """
    added = ("n_tokens", "token_ids")
    held = docs.select(F.struct("*").alias("_row"), "text")
    done = tokens.tokenized(held, column="_tokens")
    columns = {"text": F.col("_tokens.decoded")}
    return done.select(
        *[columns.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns if c.lower() not in added],
        F.size("_tokens.ids").cast("long").alias("n_tokens"),
        F.col("_tokens.ids").alias("token_ids"),
    )


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("tokens", encode),
]
# SQL knows neither the network nor the tokenizer; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table gives an empty result with all columns.

    The results of the stages stay in a folder of their own below the checkpoint folder,
    as the rows returned are read from the last one.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
