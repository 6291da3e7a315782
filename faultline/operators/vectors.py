"""Failure memory: candidate sets, similarity search, vector upkeep."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import schemas as S
from faultline.functions import vectors as X
from faultline.functions.text import let, trim

QUERY_BLOCK = 8192  # queries scored together


def normalise_vectors(df: DataFrame, vector: str = "vector") -> DataFrame:
    return df.withColumn(vector, X.normalise(vector))


def pair_similarity(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return pairs.withColumn("score", X.similarity(a, b))


def memory_candidates(
    failures: DataFrame,
    dims: int = S.EMBEDDING_DIMS,
    resolved: int = S.RESOLVED_CANDIDATES,
    unresolved: int = S.UNRESOLVED_CANDIDATES,
    hydrate=(),
) -> DataFrame:
    """Newest resolved and newest open failures of every repo, with a usable vector.

    One scan: the rank limit applies on the map side as well, so a repo with very many
    failures sends at most the larger limit per task and bucket to the shuffle. Only the
    narrow columns and those to ``hydrate`` take part. The limits come before the width
    check: a bad vector uses up a slot.
    """
    bucket = F.when(F.col("status") == "resolved", 0).otherwise(1)
    order = Window.partitionBy("repo", "bucket").orderBy(F.desc("last_seen_at"), "id")
    named = ("repo", "id", "last_seen_at", "vector")
    narrow = failures.filter(F.col("status") != "dismissed").select(
        *named, bucket.alias("bucket"), *[c for c in hydrate if c not in named]
    )
    limit = F.when(F.col("bucket") == 0, resolved).otherwise(unresolved)
    ranked = narrow.withColumn("rank", F.row_number().over(order)).filter(
        (F.col("rank") <= max(resolved, unresolved)) & (F.col("rank") <= limit)
    )
    return ranked.filter(F.size("vector") == dims)


def matrix_of(vectors: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of ``dims`` doubles; shorter vectors are filled with zeros, longer ones cut."""
    held = pa.concat_arrays(vectors.chunks)
    lengths = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), max(dims, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out[:, :dims]


def scores_of(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All dot products of two blocks; each is summed alike, so equal vectors score equally."""
    with np.errstate(invalid="ignore", over="ignore"):
        found = np.einsum("qd,cd->qc", queries, candidates)
    return np.where(np.isfinite(found), found, 0.0)


def block_scorer(k: int, min_score: float, kept: list[str]):
    """The best candidates of every query of a block; ``kept`` columns come from the candidate."""

    def score(queries: pa.Table, memory: pa.Table) -> pa.Table:
        memory = memory.sort_by([("bucket", "ascending"), ("rank", "ascending")])
        places: dict = {}
        for place, id_ in enumerate(memory["id"].to_pylist()):
            places.setdefault(id_, []).append(place)
        rows, picked = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ranks, scores = np.zeros(0, np.int64), np.zeros(0)
        if queries.num_rows and memory.num_rows:
            dims = len(memory["vector"][0])
            found = scores_of(matrix_of(queries["vector"], dims), matrix_of(memory["vector"], dims))
            found[found < min_score] = -np.inf
            for row, id_ in enumerate(queries["query_id"].to_pylist()):
                found[row, places.get(id_, [])] = -np.inf
            best = np.argsort(-found, axis=1, kind="stable")[:, :k]
            hit = np.take_along_axis(found, best, axis=1)
            rows, ranks = np.nonzero(hit > -np.inf)
            picked, scores = best[rows, ranks], hit[rows, ranks]
        asked, won = queries.take(pa.array(rows)), memory.take(pa.array(picked))
        return pa.table(
            [asked["query_id"], asked["repo"], pa.array(ranks + 1, pa.int32()), won["id"], pa.array(scores)]
            + [won[c] for c in kept],
            names=["query_id", "repo", "rank", "id", "score", *kept],
        )

    return score


def top_k_similar(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = S.MEMORY_K,
    min_score: float = S.SIMILARITY_THRESHOLD,
    hydrate=(),
) -> DataFrame:
    """Best candidates of each query (query_id, repo, vector): rank, id, score and candidate columns.

    The queries of a repo are cut into blocks of about ``QUERY_BLOCK`` and every block
    meets the candidates of its repo, 256 at most, as one product of two matrices; only
    the winners leave. A repo with very many queries is as many blocks as it needs.
    """
    k = max(1, min(k, S.MAX_NEIGHBOURS))
    # columns of their own, also where queries and candidates come from one table
    asked = queries.select(*[F.col(c).alias(c) for c in ("query_id", "repo", "vector")])
    asked = asked.filter("vector IS NOT NULL AND repo IS NOT NULL")
    blocks = asked.groupBy("repo").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    memory = candidates.join(blocks, "repo").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    dealt = asked.join(blocks, "repo").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int"))
    types = {f.name: f.dataType for f in (*candidates.schema, *queries.schema)}
    kept = [c for c in hydrate if c != "id"]
    schema = T.StructType([
        T.StructField("query_id", types["query_id"]), T.StructField("repo", types["repo"]),
        T.StructField("rank", T.IntegerType()), T.StructField("id", types["id"]),
        T.StructField("score", T.DoubleType()), *[T.StructField(c, types[c]) for c in kept],
    ])
    scored = (
        dealt.drop("blocks").groupBy("repo", "block")
        .cogroup(memory.select("repo", "block", "bucket", "rank", "id", "vector", *kept).groupBy("repo", "block"))
        .applyInArrow(block_scorer(k, min_score, kept), schema)
    )
    return scored.withColumn("score", F.round("score", 12))


def search_similar(
    queries: DataFrame,
    failures: DataFrame,
    k: int = S.MEMORY_K,
    min_score: float = S.SIMILARITY_THRESHOLD,
    dims: int = S.EMBEDDING_DIMS,
    hydrate=("status",),
) -> DataFrame:
    """Candidates, scores and the winners' columns. A query never finds itself.

    The columns of the winners come from the candidates, which are read once.
    """
    return top_k_similar(queries, memory_candidates(failures, dims, hydrate=hydrate), k, min_score, hydrate)


def missing_embeddings(failures: DataFrame, limit: int = 50) -> DataFrame:
    """Newest failures whose vector is still the all-zero placeholder."""
    return (
        failures.filter(X.is_zero("vector"))
        .orderBy(F.desc("last_seen_at"), "id")
        .limit(max(1, min(limit, 200)))
        .select("id", "signature_text")
    )


def reembed(failures: DataFrame, fresh: DataFrame) -> DataFrame:
    """Put new vectors (id, fresh) in place of placeholders; other rows are kept."""
    joined = failures.join(fresh.select("id", "fresh"), "id", "left")
    pending = X.is_zero("vector")
    return joined.withColumn("pending", pending).withColumn(
        "vector",
        F.when(F.col("pending") & F.col("fresh").isNotNull(), X.normalise("fresh")).otherwise(
            F.col("vector")
        ),
    )


def reembed_counts(reembedded: DataFrame) -> DataFrame:
    done = F.col("pending") & ~X.is_zero("vector")
    return reembedded.agg(
        F.count_if(done).alias("embedded"), F.count_if(X.is_zero("vector")).alias("remaining")
    )


def embedding_input(text) -> Column:
    return F.substring(trim(F.regexp_replace(text, "\r\n", "\n")), 1, S.EMBED_CHARS)


def embedding_inputs(df: DataFrame, text: str = "signature_text") -> DataFrame:
    """Bounded text for a vector source; ``usable`` is false for blank text."""
    out = df.withColumn("input", F.coalesce(embedding_input(F.col(text)), F.lit("")))
    return out.withColumn("usable", F.col("input") != "")


def validate_vectors(df: DataFrame, dims: int = S.EMBEDDING_DIMS, vector: str = "vector") -> DataFrame:
    return df.withColumn("valid", F.coalesce(X.is_valid(vector, dims), F.lit(False)))


def word_bucket(word, dims: int) -> Column:
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % dims


def unit_counts(buckets, dims: int) -> Column:
    """Unit vector of bucket counts from sorted bucket numbers, in one pass over them."""
    n = F.size(buckets)
    ends = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == n - 1) | (F.get(buckets, i) != F.get(buckets, i + 1)),
    )

    def zeros(count):
        return F.array_repeat(F.lit(0.0).cast("float"), count.cast("int"))

    def runs(ends):
        def run(end, j):
            before = F.when(j > 0, F.get(ends, j - 1)).otherwise(-1)
            return F.struct(
                F.get(buckets, end).alias("bucket"),
                F.when(j > 0, F.get(buckets, before)).otherwise(-1).alias("previous"),
                (end - before).cast("double").alias("count"),
            )

        return F.transform(ends, run)

    def dense(found):
        squares = F.aggregate(found, F.lit(0.0), lambda acc, r: acc + r["count"] * r["count"])

        def scaled(share):
            pieces = F.transform(
                found,
                lambda r: F.concat(
                    zeros(r["bucket"] - r["previous"] - 1),
                    F.array((r["count"] * share).cast("float")),
                ),
            )
            return F.concat(F.flatten(pieces), zeros(dims - 1 - F.get(buckets, n - 1)))

        return let(1 / F.sqrt(squares), scaled)

    return F.when(n > 0, let(let(ends, runs), dense)).otherwise(zeros(F.lit(dims)))


def hashed_vector(text, dims: int) -> Column:
    """Built-in vector source: word counts hashed into ``dims`` buckets, unit length."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    buckets = F.sort_array(F.transform(words, lambda w: word_bucket(w, dims)))
    return let(buckets, lambda bs: unit_counts(bs, dims))


def unit_rows(block: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length; rows without a direction become zeros."""
    safe = np.where(np.isfinite(block), block, 0).astype("float64")
    length = np.sqrt((safe * safe).sum(axis=1, keepdims=True))
    with np.errstate(divide="ignore", over="ignore"):
        scale = np.where(length > 0, 1 / length, 0)
    return (safe * np.where(np.isfinite(scale), scale, 0)).astype("float32")


def not_embedded(df: DataFrame, text: str = "signature_text") -> DataFrame:
    """The rows ``embed_texts`` leaves out, with the reason."""
    return (
        embedding_inputs(df, text)
        .filter(~F.coalesce("usable", F.lit(False)))
        .drop("input", "usable")
        .withColumn("reason", F.lit("blank_text"))
    )


Embedder = Callable[[list[str]], "np.ndarray"]


def embed_texts(
    df: DataFrame, text: str = "signature_text", dims: int = S.EMBEDDING_DIMS,
    embedder: Embedder | None = None,
) -> DataFrame:
    """Add ``vector`` from a user-supplied batch function, or from word hashing.

    The function gets at most fifty texts at a time and runs inside the tasks. Texts
    without content get no vector; ``not_embedded`` names them.
    """
    ready = embedding_inputs(df, text).filter("usable")
    if embedder is None:
        return ready.withColumn("vector", hashed_vector(F.col("input"), dims)).drop("input", "usable")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            out = []
            for start in range(0, len(texts), S.EMBED_BATCH):
                part = texts[start : start + S.EMBED_BATCH]
                block = np.asarray(embedder(part), dtype="float32")
                if block.shape != (len(part), dims):
                    raise ValueError(f"expected {(len(part), dims)} values, got {block.shape}")
                out.extend(unit_rows(block))
            yield pd.Series(out)

    return ready.withColumn("vector", run("input")).drop("input", "usable")


def byte_rows(rows: np.ndarray, present: np.ndarray) -> pa.Array:
    """One binary value per present row, from one buffer; null for the others."""
    sizes = np.where(present, rows.shape[1] * rows.itemsize, 0)
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    data = pa.py_buffer(np.ascontiguousarray(rows[present]).tobytes())
    valid = pa.py_buffer(np.packbits(present, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [valid, pa.py_buffer(offsets.tobytes()), data])


def encode_vectors(df: DataFrame, dims: int = S.EMBEDDING_DIMS, vector: str = "vector") -> DataFrame:
    """Unit vectors as little-endian float32 bytes, zero-padded to ``dims``; wider is an error."""

    def pack(values: pa.Array) -> pa.Array:
        lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        if lengths.max(initial=0) > dims:
            raise ValueError(f"at most {dims} dimensions, got {lengths.max()}")
        block = np.zeros((len(values), dims))
        block[np.arange(dims) < lengths[:, None]] = values.flatten().to_numpy(zero_copy_only=False)
        return byte_rows(unit_rows(block).astype("<f4"), values.is_valid().to_numpy(zero_copy_only=False))

    return df.withColumn("blob", F.arrow_udf(pack, T.BinaryType())(F.col(vector)))


def decode_vectors(df: DataFrame, dims: int = S.EMBEDDING_DIMS, blob: str = "blob") -> DataFrame:
    """Bytes back to a vector; a blob of another width reads as null."""

    def unpack(blobs: pa.Array) -> pa.Array:
        fits = pc.equal(pc.binary_length(blobs), dims * 4).fill_null(False)
        kept = blobs.filter(fits)
        flat = np.frombuffer(b"".join(kept.to_pylist()), dtype="<f4") if len(kept) else np.zeros(0, "<f4")
        mask = fits.to_numpy(zero_copy_only=False)
        offsets = np.r_[0, np.cumsum(mask) * dims].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(~mask))

    return df.withColumn("decoded", F.arrow_udf(unpack, T.ArrayType(T.FloatType()))(F.col(blob)))
