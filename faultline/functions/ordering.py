"""Row numbers over a whole table without a single-task sort."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.sources.checkpoints import checkpointed

PARTITION_SHIFT = 33  # monotonically_increasing_id keeps the partition above this bit


def with_row_numbers(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Number the rows 1..n in ``order``.

    A range sort gives balanced, ordered partitions even when one key holds much
    of the table. The sorted rows are checkpointed, because a lost executor must
    not change the partition bounds between the count and the numbering. The
    offsets are one row per partition.
    """
    part = F.shiftright(F.col("_pos"), PARTITION_SHIFT)
    ranged = df.sort(*order).withColumn("_pos", F.monotonically_increasing_id())
    stable = checkpointed(ranged.withColumn("_part", part))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stable.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select("_part", "_before")
    )
    within = F.col("_pos").bitwiseAND(F.lit((1 << PARTITION_SHIFT) - 1))
    # bounded: at most one row per shuffle partition
    return (
        stable.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + within + 1)
        .drop("_pos", "_part", "_before")
    )
