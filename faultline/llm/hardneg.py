"""Hard negatives by exact integer scores from packed products.

Vectors become whole numbers, ``floor(scale * x)``. Several candidates are packed into
one wide integer per component: each candidate's component is biased to be no less than
zero and stands in a field of its own, ``width`` bits apart. One multiplication of an
anchor's component with the packed one multiplies it with all these candidates at once;
the products are added up over the components, still packed, and the fields of the sum
are the scores plus a known bias. A field is as wide as the largest sum that the block
at hand can give, so no field reaches into the next. Wide integers below 2^53 are held
in doubles, which are exact there and multiply as matrices; where a field needs more
bits than that, they are Python integers of any width.

The anchors are the stated query set: blocks of anchors meet blocks of all rows, one
pair of blocks is one task of bounded size, and each gives its best few rows per
anchor. A first pass finds the positives of every anchor, a second one the rows of
other labels in the score windows these positives set.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component take no part; a component that a shorter vector lacks counts as zero; ties
are ordered by id; rows that share an anchor's id are not its positives or negatives;
repeated rows count as often as they occur, repeated anchors once; the score of a
positive beyond the range of a long counts as the end of that range; an anchor without positives, and
a positive without a row in its window, give no row. Other columns are not read.
"""

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.ordering import with_row_numbers
from faultline.sources.checkpoints import checkpointed

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
ANCHOR_BLOCK = 32_768
ROW_BLOCK = 16_384
STRIP = 64  # anchors multiplied at once
EXACT = 50  # bits of a packed number held in a double; three less than would be exact, for the ranking keys
LONG = 2**63 - 1
BEST = "anchor long, id long, score long"
PAIR = (
    "anchor long, positive long, positive_id long, positive_score long, negative_id long, negative_score long"
)


def takes_part(vector: Column, scale: int) -> Column:
    finite = F.forall(
        vector, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < float("inf"), F.lit(False))
    )
    return F.coalesce(finite, F.lit(False))


def whole_numbers(vectors: pa.Array, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as a matrix, short vectors filled with zeros.

    Longs, or Python integers where a component would leave a double's exact range.
    """
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    huge = len(flat) > 0 and np.abs(flat).max() >= 2.0**31
    values = np.array([int(x) for x in flat], dtype=object) if huge else flat.astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), dtype=values.dtype)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def same_length(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, size - m.shape[1]))) for m in (a, b))


class Packed:
    """A block of candidates, ``fields`` of them in each wide integer."""

    def __init__(self, rows: np.ndarray, weight: int):
        """``weight``: the largest sum of absolute components among the anchors."""
        self.count = len(rows)
        self.bias = int(np.abs(rows).max(initial=0))
        # biased components are at most 2 * bias; one more bit for the sign of the anchors
        self.width = (2 * self.bias * weight).bit_length() + 1
        self.wide = self.width > EXACT
        self.fields = 4 if self.wide else EXACT // self.width
        groups = ceil(self.count / self.fields)
        biased = np.zeros((groups * self.fields, rows.shape[1]), dtype=object if self.wide else np.int64)
        biased[: self.count] = rows + self.bias
        stacked = biased.reshape(groups, self.fields, rows.shape[1])
        packed = sum(stacked[:, f] * (1 << self.shift(f)) for f in range(self.fields))
        self.packed = (packed if self.wide else packed.astype(np.float64)).T

    def shift(self, field: int) -> int:
        return self.width * field

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """The exact inner products (anchors x candidates)."""
        if self.wide:
            anchors = anchors.astype(object)
            sums = anchors @ self.packed
        else:
            sums = (anchors.astype(np.float64) @ self.packed).astype(np.int64)
        lift = 1 << (self.width - 1)  # no field of the sum is below zero then
        sums = sums + sum(lift << self.shift(f) for f in range(self.fields))
        mask = (1 << self.width) - 1
        parts = [((sums >> self.shift(f)) & mask) - lift for f in range(self.fields)]
        unpacked = np.stack(parts, axis=2).reshape(len(anchors), -1)[:, : self.count]
        return unpacked - self.bias * anchors.sum(axis=1)[:, None]


def column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table.column(name).chunks)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return column(table, name).to_numpy(zero_copy_only=False)


def ranked_strips(anchors: pa.Table, rows: pa.Table, scale: int, same_label: bool):
    """For each anchor, by strips: its number in the block and its ranking keys in ascending order.

    A key is the score, then the id: ``score << bits`` plus the candidate's place from
    the end when ordered by id. Candidates that do not qualify have the lowest key.
    """
    rows = rows.sort_by("vec_id")
    asked, held = same_length(
        whole_numbers(column(anchors, "vector"), scale), whole_numbers(column(rows, "vector"), scale)
    )
    packed = Packed(held, int(np.abs(asked).sum(axis=1).max(initial=0)))
    ids, labels = numbers(rows, "vec_id"), numbers(rows, "label")
    own_ids, own_labels = numbers(anchors, "vec_id"), numbers(anchors, "label")
    bits = len(ids).bit_length()
    places = np.arange(len(ids) - 1, -1, -1)
    lowest = -float("inf") if packed.wide else -(1 << 62)
    for start in range(0, len(asked), STRIP):
        strip = slice(start, start + STRIP)
        keys = (packed.scores(asked[strip]) << bits) + places
        qualified = (labels == own_labels[strip, None]) == same_label
        qualified &= ids != own_ids[strip, None]
        keys = np.sort(np.where(qualified, keys, lowest), axis=1)
        yield start, keys, lowest, bits, ids


def positives_in(scale: int, wanted: int):
    """The best rows of the anchor's label in one block of rows, for every anchor of a block."""

    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = ([], [], [])
        if anchors.num_rows and rows.num_rows:
            number = numbers(anchors, "anchor")
            for start, keys, lowest, bits, ids in ranked_strips(anchors, rows, scale, True):
                for k, best in enumerate(keys[:, -wanted:]):
                    for key in best[best > lowest].tolist():
                        out[0].append(int(number[start + k]))
                        out[1].append(int(ids[len(ids) - 1 - (key & ((1 << bits) - 1))]))
                        out[2].append(max(-LONG - 1, min(LONG, key >> bits)))
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["anchor", "id", "score"])

    return find


def negatives_in(scale: int, wanted: int, low: int, high: int):
    """The best rows of other labels below each positive of each anchor, in one block of rows."""

    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = ([], [], [], [], [], [])
        if anchors.num_rows and rows.num_rows:
            asked = anchors.select(["anchor", "vec_id", "positives"]).to_pylist()
            for start, keys, _, bits, ids in ranked_strips(anchors, rows, scale, False):
                for k, row in enumerate(keys):
                    anchor = asked[start + k]
                    for positive in anchor["positives"]:
                        score = positive["score"]
                        most = (high * score) // 100
                        least = -((-low * score) // 100)
                        end = np.searchsorted(row, (most + 1) << bits)
                        begin = max(np.searchsorted(row, least << bits), end - wanted)
                        for key in row[begin:end].tolist():
                            out[0].append(anchor["anchor"])
                            out[1].append(positive["rank"])
                            out[2].append(positive["id"])
                            out[3].append(score)
                            out[4].append(int(ids[len(ids) - 1 - (key & ((1 << bits) - 1))]))
                            out[5].append(max(-LONG - 1, min(LONG, key >> bits)))
        names = ["anchor", "positive", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=names)

    return find


def against_all(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], work, schema: str) -> DataFrame:
    """``work`` on every pair of an anchor block and a row block, each pair a task of bounded size."""
    of_anchors, of_rows = blocks
    some = F.explode(F.sequence(F.lit(0), F.lit(of_rows - 1))).alias("row_block")
    every = F.explode(F.sequence(F.lit(0), F.lit(of_anchors - 1))).alias("anchor_block")
    pair = ["anchor_block", "row_block"]
    return (
        anchors.select("*", some).groupBy(*pair)
        .cogroup(rows.select("*", every).groupBy(*pair))
        .applyInArrow(work, schema)
    )


def first_by_score(found: DataFrame, keys: list[str], score: str, tie: str, wanted: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, scale: int = SCALE, positives: int = POSITIVES,
    negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK,
) -> DataFrame:
    """For each anchor and positive, the best rows of other labels in the positive's score window.

    Rows: vec_id, label, vector. Result: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.
    """
    usable = rows.select("vec_id", "label", "vector").filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & takes_part(F.col("vector"), scale)
    )
    asked = usable.filter(is_anchor).distinct()
    numbered = with_row_numbers(asked, ["vec_id", "label", "vector"]).withColumn("anchor", F.col("number") - 1)
    anchors = numbered.select(
        "anchor", "vec_id", "label", "vector", F.expr(f"int(anchor div {anchor_block})").alias("anchor_block")
    )
    blocks = (max(1, ceil(numbered.count() / anchor_block)), max(1, ceil(usable.count() / row_block)))
    # rows of one id may be very many, so blocks are dealt by place, not by id
    dealt = usable.select(
        *[F.col(c).alias(c) for c in usable.columns],  # columns of their own, apart from the anchors'
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks[1])).cast("int").alias("row_block"),
    )
    best = against_all(anchors, dealt, blocks, positives_in(scale, positives), BEST)
    chosen = checkpointed(first_by_score(best, ["anchor"], "score", "id", positives))
    windows = chosen.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), "id", "score"))).alias("positives")
    )
    found = against_all(
        anchors.join(windows, "anchor"), dealt, blocks, negatives_in(scale, negatives, low, high),
        PAIR,
    )
    ranked = first_by_score(found, ["anchor", "positive"], "negative_score", "negative_id", negatives)
    named = ranked.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def negatives_report(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the vectors whose id is divisible by 100, with every seventh label moved on."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.col("embedding").alias("vector")
    )
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)
