"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments and indexed once per segment. A query looks up, in
every segment, the values at segment distance 0, then 1, then 2, ...; every code
found is verified with its full Hamming distance. After radius r in all m
segments every code at distance m * (r + 1) - 1 or less has been met (else each
segment would differ in more than r bits), so a query whose k-th verified
distance is within that bound is complete, ties included, and leaves.

Equal codes are one entry of the index with their number of rows and their k + 1
smallest ids, chosen by a rank that also filters before the shuffle; equal query
codes are one query. A code shared by a third of all rows is one row.

Defined results: a vector that is null or has another length than ``bits`` has
no code and neither searches nor is found; an element is set when above zero, so
null elements are clear; ties are ordered by id, null ids last; a row is not its
own neighbour, but another row with the same code is; repeated ids are found as
often as they occur; with fewer than k other rows all of them are returned.
"""

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.sources.checkpoints import checkpointed

K = 10
BITS = 64
SEGMENT = 16


def code_of(vector: str = "embedding", bits: int = BITS) -> Column:
    """The sign pattern of a vector as one long, first element in the lowest bit."""
    bit = F.transform(
        F.col(vector),
        lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(
            F.lit(0).cast("long")
        ),
    )
    return F.when(
        F.size(F.col(vector)) == bits,
        F.aggregate(bit, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)),
    )


def segment_value(code: Column, number: int, width: int) -> Column:
    return F.shiftrightunsigned(code, number * width).bitwiseAND(F.lit((1 << width) - 1))


def masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in chosen) for chosen in combinations(range(width), radius)]


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def indexed_codes(rows: DataFrame, k: int) -> DataFrame:
    """One row per code: its count and its k + 1 smallest ids."""
    ranked = Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last())
    few = rows.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= k + 1)
    return few.groupBy("code").agg(
        F.array_sort(F.collect_list(F.struct("_rank", "id"))).alias("members")
    )


def segments_of(codes: DataFrame, keep: list[str], name: str, bits: int, width: int) -> DataFrame:
    pieces = F.array(
        *[
            F.struct(F.lit(s).alias("seg"), segment_value(F.col(name), s, width).alias("value"))
            for s in range(bits // width)
        ]
    )
    return codes.select(*keep, F.inline(pieces))


def nearest_codes(
    queries: DataFrame, codes: DataFrame, k: int, bits: int = BITS, width: int = SEGMENT
) -> DataFrame:
    """(query, code, distance): all codes needed for the k + 1 nearest rows of each query code."""
    count = bits // width
    index = checkpointed(segments_of(codes.select("code"), ["code"], "code", bits, width))
    sizes = codes.select("code", F.size("members").alias("rows"))
    everything = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    tasks = 2 * codes.sparkSession.sparkContext.defaultParallelism
    running = Window.partitionBy("query").orderBy("distance").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    nearer = Window.partitionBy("query").orderBy("distance").rangeBetween(
        Window.unboundedPreceding, -1
    )
    open_ = checkpointed(
        queries.select(F.col("code").alias("query"), F.lit(bits + 1).alias("limit"))
    )
    best = done = None
    for radius in range(width + 1):
        flips = F.split(F.lit(",".join(map(str, masks(width, radius)))), ",").cast("array<bigint>")
        # few queries are many probes, so they are dealt to all cores before they multiply
        asked = segments_of(open_, ["query", "limit"], "query", bits, width).repartition(tasks, "query", "seg")
        probes = asked.select(
            "query",
            "limit",
            "seg",
            F.explode(F.transform(flips, lambda m: F.col("value").bitwiseXOR(m))).alias("value"),
        )
        # few rows become many probes behind the last size that Spark knows, so it must not broadcast them
        found = (
            probes.join(index.hint("merge"), ["seg", "value"])
            .withColumn("distance", distance("query", "code"))
            .filter("distance <= limit")
            .select("query", "code", "distance")
            .distinct()
            .join(sizes, "code")
            .select("query", "code", "distance", "rows")
        )
        known = found if best is None else best.unionByName(found).distinct()
        # codes beyond the k + 1 nearest rows seen so far can never be needed
        near = checkpointed(
            known.withColumn("_nearer", F.coalesce(F.sum("rows").over(nearer), F.lit(0)))
            .withColumn("_reach", F.sum("rows").over(running))
            .filter(F.col("_nearer") <= k)
        )
        # the k-th verified distance so far: nothing beyond it can be needed
        limits = near.groupBy("query").agg(
            F.min(F.when(F.col("_reach") > k, F.col("distance"))).alias("kth"), F.max("_reach").alias("met")
        )
        state = checkpointed(open_.join(limits, "query", "left").fillna(0, ["met"]))
        # nothing is left to look for once all rows have been met
        covered = F.lit(radius == width) | (F.col("kth") <= count * (radius + 1) - 1) | (F.col("met") >= everything)
        complete = state.filter(covered).select("query")
        near = near.select("query", "code", "distance", "rows")
        # stored round by round, so no plan grows with the rounds
        settled = checkpointed(near.join(complete, "query", "left_semi"))
        done = settled if done is None else done.unionByName(settled)
        open_ = state.filter(~F.coalesce(covered, F.lit(False))).select(
            "query", F.coalesce("kth", "limit").alias("limit")
        )
        if open_.isEmpty():
            break
        best = near.join(complete, "query", "left_anti")
    return done


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    bits: int = BITS,
    width: int = SEGMENT,
    id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """The k nearest other rows of each query row: query_id, rank, neighbour_id, distance."""

    def coded(df: DataFrame) -> DataFrame:
        return df.select(F.col(id).alias("id"), code_of(vector, bits).alias("code")).filter(
            "code IS NOT NULL"
        )

    rows, asked = checkpointed(coded(vectors)), checkpointed(coded(queries))
    codes = checkpointed(indexed_codes(rows, k))
    near = nearest_codes(asked.select("code").distinct(), codes, k, bits, width)
    members = near.join(codes, "code").select(
        "query", "distance", F.explode("members").alias("m")
    )
    order = Window.partitionBy("query").orderBy("distance", F.col("m.id").asc_nulls_last())
    lists = (
        members.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= k + 1)
        .groupBy("query")
        .agg(F.array_sort(F.collect_list(F.struct("_n", "m.id", "distance"))).alias("near"))
    )
    # a row of the query's own id and code leaves its list once, wherever it stands among the ties
    own = F.filter(F.col("near"), lambda x: (x["distance"] == 0) & x["id"].eqNullSafe(F.col("id")))
    others = F.filter(F.col("near"), lambda x: ~x["_n"].eqNullSafe(F.col("_own")))
    ranked = (
        asked.join(lists, asked.code == lists.query)
        .withColumn("_own", F.get(own, F.lit(0))["_n"])
        .withColumn("near", F.slice(others, 1, k))
    )
    return ranked.select(
        F.col("id").alias("query_id"), F.posexplode("near").alias("_at", "_hit")
    ).select(
        "query_id",
        (F.col("_at") + 1).cast("long").alias("rank"),
        F.col("_hit.id").alias("neighbour_id"),
        F.col("_hit.distance").cast("long").alias("distance"),
    )
