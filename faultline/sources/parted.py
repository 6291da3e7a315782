"""The failures table in parts by id, of which a merge reads and writes only those it changes.

A row lies in the part its id hashes to. The number of parts grows with the table when
it is written anew and stays as it is when it is merged into. A manifest lists the
folder of every part; a merge writes the changed parts to new folders and a new
manifest, in which the other parts keep the folders they have. Until the manifest is
there the old one holds, so a failed merge leaves the table as it was; folders no
manifest names any more are the caller's to delete.

The rows of the snapshot stay in the tasks that read them: a change set of up to
``MERGE_ROWS`` ids is broadcast by its id and refreshed columns, and only new rows are
dealt to their parts. Larger change sets are joined by shuffle, as they touch most
parts anyway.
"""

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.operators import failures as ops
from faultline.sources.checkpoints import checkpointed

PART_ROWS = 500_000  # rows of a part when the table is written
FILES = 8  # files of a part when the table is written
MERGE_ROWS = 20_000  # changed ids that are broadcast, with a vector each: about 32 MB
MANIFEST = "part int, folder string, parts int"


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")


def write_manifest(spark: SparkSession, folders: dict[int, str], parts: int, path: str) -> str:
    """One row per part; the name of the manifest is the name of the table's state."""
    target = f"{path}/manifest-{uuid4().hex}"
    rows = [(part, folder, parts) for part, folder in sorted(folders.items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(target)
    return target


def read_manifest(spark: SparkSession, manifest: str) -> tuple[dict[int, str], int]:
    rows = spark.read.schema(MANIFEST).parquet(manifest).collect()  # one row per part
    return {r.part: r.folder for r in rows}, max((r.parts for r in rows), default=1)


def write_parts(rows: DataFrame, path: str) -> dict[int, str]:
    """The folders of the parts that have rows; rows carry their ``part``."""
    target = f"{path}/data-{uuid4().hex}"
    rows.write.partitionBy("part").parquet(target)
    written = rows.sparkSession.read.parquet(target).select("part").distinct().collect()
    return {r.part: f"{target}/part={r.part}" for r in written}


def write_table(table: DataFrame, path: str, part_rows: int = PART_ROWS) -> str:
    """The whole table, anew, in as many parts as its rows ask for."""
    rows = S.conform(table, S.FAILURES)
    count = rows.count()
    parts = max(1, -(-count // part_rows))
    files = F.pmod(F.xxhash64(F.lit(0), "id"), F.lit(FILES))  # a part is written by several tasks
    dealt = rows.withColumn("part", part_of(parts)).repartition(FILES * parts, "part", files).sortWithinPartitions("part", "id")
    folders = write_parts(dealt, path) if count else {}
    return write_manifest(rows.sparkSession, folders, parts, path)


def read_table(spark: SparkSession, manifest: str, only: set[int] | None = None) -> DataFrame:
    """The table, or some of its parts."""
    folders, _ = read_manifest(spark, manifest)
    wanted = [folder for part, folder in folders.items() if only is None or part in only]
    return spark.read.schema(S.FAILURES).parquet(*wanted) if wanted else spark.createDataFrame([], S.FAILURES)


def parts_named(spark: SparkSession, manifest: str, ids: DataFrame) -> set[int]:
    """The parts in which the ids of a table lie: at most as many as there are parts."""
    _, parts = read_manifest(spark, manifest)
    return {r.part for r in ids.select(part_of(parts)).distinct().collect()}


def read_named(spark: SparkSession, manifest: str, ids: DataFrame) -> DataFrame:
    """The parts of the table that can hold the ids of another table."""
    return read_table(spark, manifest, parts_named(spark, manifest, ids))


def merged(old: DataFrame, fresh: DataFrame, broadcast: bool) -> tuple[DataFrame, DataFrame]:
    """The old rows with what is refreshed, and the rows of new ids."""

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if broadcast else df

    newest = fresh.select("id", F.struct(*[f"newest.{c}" for c in ops.REFRESHED]).alias("newest"))
    values = {c: F.coalesce(f"newest.{c}", c).alias(c) for c in ops.REFRESHED}
    refreshed = old.join(small(newest), "id", "left").select(*[values.get(c, F.col(c)) for c in old.columns])
    known = old.select("id").join(small(fresh.select("id")), "id", "left_semi")
    first = {c: F.col(f"newest.{c}") for c in ops.REFRESHED}
    new = fresh.join(known, "id", "left_anti").select(
        *[first.get(c, F.col(f"first.{c}")).alias(c) for c in old.columns]
    )
    return refreshed, new


def merge(spark: SparkSession, manifest: str, incoming: DataFrame, path: str, order: str = "seq") -> str:
    """The next manifest after an upsert (see ``operators.failures.upsert_failures``)."""
    folders, parts = read_manifest(spark, manifest)
    fresh = checkpointed(ops.arrivals(incoming, [f.name for f in S.FAILURES], order))
    touched = parts_named(spark, manifest, fresh)
    if not touched:
        return manifest
    old = read_table(spark, manifest, touched)
    refreshed, new = merged(old, fresh, fresh.count() <= MERGE_ROWS)
    rows = S.conform(refreshed, S.FAILURES).withColumn("part", part_of(parts)).unionByName(
        S.conform(new, S.FAILURES).withColumn("part", part_of(parts)).repartition("part")
    )
    return write_manifest(spark, {**folders, **write_parts(rows, path)}, parts, path)
