"""Connected components of a table of links by label propagation with jumps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import packed
from faultline.sources.checkpoints import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b); the label is the smallest node reachable.

    Each round takes the smallest label of the neighbours and then the label of
    that label, so a star ends in one round and a chain in few. Minima are merged
    before the shuffle, so a node with very many links is no burden.
    """
    ends = F.array(
        F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("node"), F.col("a").alias("other")),
    )
    both = checkpointed(links.select(F.inline(ends)).distinct())
    rows = both.count()  # of no step are there more, but for one label of each node
    both = packed(both, rows)
    labels = checkpointed(
        packed(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), rows)
    )
    while True:
        heard = both.join(labels.withColumnRenamed("node", "other"), "other").select("node", "label")
        lowest = packed(heard.unionByName(labels), rows).groupBy("node").agg(F.min("label").alias("near"))
        roots = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        joined = (
            packed(packed(lowest, rows).join(roots, "near", "left"), rows)
            .join(labels.withColumnRenamed("label", "old"), "node")
            .select("node", F.least("near", "far").alias("label"), "old")
        )
        stepped = checkpointed(packed(joined, rows))
        changed = not stepped.filter("label < old").isEmpty()
        labels = stepped.select("node", "label")
        if not changed:
            return labels
