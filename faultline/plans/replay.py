"""Stored tables sent through the stream operators, one micro-batch after the other."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources.checkpoints import checkpoint_dir
from faultline.streaming.claims import ROCKSDB

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that the stateful processors need, in at most as many parts as there are cores.

    Every part is a store and a worker of its own in every micro-batch, however few rows it has.
    """
    parts = min(int(spark.conf.get(PARTITIONS)), max(spark.sparkContext.defaultParallelism, 2))
    before = {name: spark.conf.get(name) for name in (PROVIDER, PARTITIONS)}
    spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set(PARTITIONS, str(parts))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def replayed(
    sources: list[tuple[DataFrame, Column]], slices: int, through: Callable[..., DataFrame], key: list[str] | None = None
) -> DataFrame:
    """What ``through`` gives for streams of the sources, each row arriving in its slice (from 0 on).

    The query stops after every slice and goes on from its checkpoint. With a ``key``
    it runs in update mode and the last row of every key is returned, otherwise all rows.
    """
    spark = sources[0][0].sparkSession
    folder = f"{checkpoint_dir(spark)}/replay-{uuid4().hex}"
    for i, (rows, slice_) in enumerate(sources):
        rows.withColumn("_slice", slice_.cast("int")).write.partitionBy("_slice").parquet(f"{folder}/rows{i}")
    with state_store(spark):
        for k in range(slices):
            streams = []
            for i, (rows, _) in enumerate(sources):
                arrived = spark.read.parquet(f"{folder}/rows{i}").filter(F.col("_slice") == k).drop("_slice")
                arrived.write.mode("append").parquet(f"{folder}/in{i}")
                streams.append(spark.readStream.schema(rows.schema).parquet(f"{folder}/in{i}"))
            run_once(through(*streams), folder, "append" if key is None else "update")
    out = spark.read.parquet(f"{folder}/out")
    if key is None:
        return out
    others = [c for c in out.columns if c not in (*key, "batch")]
    last = out.groupBy(*key).agg(F.max_by(F.struct(*others), "batch").alias("last"))
    return last.select(*key, "last.*")


def run_once(stream: DataFrame, folder: str, mode: str) -> None:
    """Everything that has arrived, through to the output folder."""
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/out").start()
    else:
        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

        query = writer.foreachBatch(write).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
