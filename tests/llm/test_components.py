import random

import pytest

from faultline.llm import common
from faultline.llm.components import components


@pytest.mark.parametrize("packed_rows, partitions", [(50_000, 1), (100, 4), (1, 16)])
def test_few_links_stay_in_few_partitions(spark, monkeypatch, packed_rows, partitions):
    """A step over few links writes few files, whatever the number of shuffle partitions."""
    monkeypatch.setattr(common, "PACKED_ROWS", packed_rows)
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    links = [(n, n + 3) for n in range(0, 60)] + [(100, n) for n in range(101, 221)] + [(-5, 400)] * 3
    random.Random(1).shuffle(links)
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = components(spark.createDataFrame(links, "a long, b long").repartition(8))
        count = found.rdd.getNumPartitions()
        rows = sorted(map(tuple, found.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {n: n % 3 for n in range(63)} | {n: 100 for n in range(100, 221)} | {-5: -5, 400: -5}
    assert rows == sorted(want.items())
    assert count == partitions
