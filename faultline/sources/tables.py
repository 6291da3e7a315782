"""Readers and writers of the CI tables.

Layout: Parquet, failures partitioned by ``bucket`` (a hash of the repo) and
sorted by repo and time inside a file. A snapshot is written to a new directory
whose name the writer returns, so a failed write leaves the old table in place.
"""

import math
import re
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import schemas as S
from faultline.operators import failures as ops

BUCKETS = 64
TASK_ROWS = 50_000


def read_failures(spark: SparkSession, path: str, vectors: bool = False) -> DataFrame:
    """Failures with the fixed schema; the vector column is read only when asked for."""
    columns = [f.name for f in S.FAILURES] if vectors else S.FAILURE_COLUMNS
    return spark.read.schema(S.FAILURES).parquet(path).select(*columns)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return ops.scan_runs(spark.read.schema(S.RUNS).parquet(path))


def read_deliveries(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Recorded deliveries as JSON lines (delivery_id, received_at, headers, raw_body)."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(S.DELIVERIES).json(path)


def read_bodies(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One bare body per file; the file name is the delivery id."""
    reader = spark.readStream if stream else spark.read
    files = reader.option("wholetext", "true").text(path)
    return files.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("delivery_id"),
        F.unix_millis(F.col("_metadata.file_modification_time")).alias("received_at"),
        F.create_map().cast("map<string,string>").alias("headers"),
        F.col("value").alias("raw_body"),
    )


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript lines with their file and their place in it.

    A large file is read in blocks by several tasks. The block offset orders the
    blocks and the row id, which grows within a task, orders the lines of one.
    """
    lines = spark.read.text(path).withColumn("row_id", F.monotonically_increasing_id())
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), "row_id")
    return lines.select(
        F.col("_metadata.file_path").alias("session"), place.alias("line_no"),
        F.col("value").alias("line"),
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a table out so that all cores have work and no task has more than ``TASK_ROWS`` rows.

    A row of a log or a delivery takes a part of a millisecond, and a file of some
    megabytes holds millions of them in a few row groups, whatever its number of splits:
    so the rows of every split are counted. A table whose splits are small enough is
    returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    if len(splits) >= cores and max(splits) <= TASK_ROWS:
        return df
    return df.repartition(max(cores, math.ceil(sum(splits) / TASK_ROWS)), key)


def write_failures(table: DataFrame, path: str) -> str:
    """Write a whole snapshot next to the others and return its directory.

    Rows are spread by id within a repo bucket, so a repo with a third of all
    rows is written by many tasks.
    """
    target = f"{path}/snapshot-{uuid4().hex}"
    bucket = F.pmod(F.xxhash64("repo"), F.lit(BUCKETS)).cast("int")
    rows = S.conform(table, S.FAILURES).withColumn("bucket", bucket)
    (
        rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(16)))
        .sortWithinPartitions("bucket", "repo", "status", F.desc("last_seen_at"))
        .write.partitionBy("bucket")
        .parquet(target)
    )
    return target


def upsert_into(spark: SparkSession, current: str | None, incoming: DataFrame, path: str) -> str:
    """New snapshot of a failures table after an upsert; ``incoming`` has a ``seq`` column."""
    old = (
        read_failures(spark, current, vectors=True)
        if current
        else spark.createDataFrame([], S.FAILURES)
    )
    return write_failures(ops.upsert_failures(old, incoming), path)


def write_changes(rows: DataFrame, path: str, batch_id: int) -> None:
    """Rows of one micro-batch; writing the batch again replaces it."""
    S.conform(rows, S.FAILURES).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_changes(spark: SparkSession, changes: str) -> DataFrame:
    """The changes written so far; what lands later is not in this table."""
    schema = T.StructType([*S.FAILURES, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(changes)


def batches_of(changes: DataFrame) -> list[int]:
    """The micro-batches a table of changes is read from."""
    return sorted({int(n) for path in changes.inputFiles() for n in re.findall(r"/batch=(\d+)/", path)})


def applied(spark: SparkSession, snapshot: str | None, fresh: DataFrame) -> DataFrame:
    old = (
        read_failures(spark, snapshot, vectors=True)
        if snapshot
        else spark.createDataFrame([], S.FAILURES)
    )
    return ops.upsert_failures(old, fresh.withColumn("seq", F.struct("batch", "last_seen_at")).drop("batch"))


def current_failures(
    spark: SparkSession, snapshot: str | None, changes: str, resolutions: str | None = None
) -> DataFrame:
    """Snapshot with the micro-batch changes, and the resolutions if named, applied."""
    table = applied(spark, snapshot, read_changes(spark, changes))
    if resolutions is None:
        return table
    return ops.mark_resolved(table, spark.read.parquet(resolutions))


def compacted(spark: SparkSession, snapshot: str | None, changes: str, path: str) -> tuple[str, list[int]]:
    """The next snapshot and the batches it holds: the caller retires the folders of these.

    A batch that lands meanwhile is not among them and stays for the next compaction.
    """
    fresh = read_changes(spark, changes)
    return write_failures(applied(spark, snapshot, fresh), path), batches_of(fresh)


def compact(spark: SparkSession, snapshot: str | None, changes: str, path: str) -> str:
    """The next snapshot alone; see ``compacted``."""
    return compacted(spark, snapshot, changes, path)[0]


def append_runs(steps: DataFrame, path: str) -> None:
    ops.audit_rows(steps).write.mode("append").parquet(path)


def write_outbox(outbox: DataFrame, path: str) -> None:
    outbox.write.mode("append").partitionBy("reason").parquet(path)


def write_prompt_report(entries: DataFrame, path: str) -> None:
    """The numbered report as text parts, in order."""
    block = F.concat(
        F.col("heading"), F.lit("\n\n```text\n"), F.col("text"), F.lit("\n```\n")
    )
    entries.sort("number").select(block.alias("value")).write.text(path)
