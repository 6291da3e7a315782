"""Helpers shared by the corpus operators."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources.checkpoints import checkpointed

SPACE = r"[\x20\x09-\x0D]"  # what parts words; every other character belongs to one
SPACES = " \t\n\x0b\x0c\r"
BROADCAST_ROWS = 50_000  # a narrow side of at most so many rows may be broadcast
PACKED_ROWS = 50_000  # rows of a narrow table in one partition, at least, where it has fewer than shuffles make


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE + "+"))).cast("long")


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for a text without words."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE + "+")
    )


def id_text(name: str = "doc_id") -> Column:
    """The id as text; a null id reads as an empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def remainder(divisor: int, name: str = "doc_id") -> Column:
    return (F.crc32(id_text(name)) % divisor).cast("int")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored narrow table when its counted rows allow it, else leave it to Spark."""
    return F.broadcast(df) if df.count() <= rows else df


def packed(df: DataFrame, rows: int) -> DataFrame:
    """A narrow table of counted rows in as few partitions as they need; a large one as it is.

    Every task of a shuffle writes files of its own, however few rows it has: so a step over
    a few thousand rows in hundreds of partitions takes more disk for files than for rows.
    Steps over one partition need no shuffle.
    """
    parts = max(1, -(-rows // PACKED_ROWS))
    return df.coalesce(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def settled(df: DataFrame) -> DataFrame:
    """A narrow table, checkpointed, in as few partitions as its rows need."""
    kept = checkpointed(df)
    return packed(kept, kept.count())


def with_values(rows: DataFrame, table: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Left join with a stored table of one row per key that tells how many rows each key has.

    Keys with more than one in ``BROADCAST_ROWS`` of all rows are broadcast; by their
    share there are never more than ``BROADCAST_ROWS`` of them. The others are joined
    by shuffle, where none of them can be hot. Rows with a null key find nothing and
    take no part in the shuffle.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    frequent = F.col(count) * BROADCAST_ROWS > total
    near = rows.join(F.broadcast(table.filter(frequent).withColumn("_found", F.lit(True))), key, "left")
    settled = near.filter(F.col("_found") | F.col(key).isNull()).drop("_found")
    rest = near.filter(F.col("_found").isNull() & F.col(key).isNotNull()).select(*rows.columns)
    return settled.unionByName(rest.join(table.filter(~frequent), key, "left"))
