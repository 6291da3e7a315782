"""Merkle manifest of a dataset: append logs in postorder, proofs by closed-form positions.

A leaf is the hash of a row. The leaves of a tree are cut into aligned blocks of
``2 ** HEIGHT``. A builder appends the nodes of its block to a log in the order in
which they are completed, which is postorder: every node behind all nodes below it.
The last node is the root of the block, and the roots of the blocks are the leaves of
the next tier, until a tree has one block. A block that is not full is closed by
raising its last open node, alone or with the one left of it, level by level.

No node stores a link. After ``m`` leaves a log holds ``2 m - popcount(m)`` complete
nodes, so the node of level ``l`` and number ``k`` that is completed by leaf ``e`` is
at ``2 e - popcount(e) + l``; nodes that only the closing completes follow in order of
level. Proofs read the siblings of a leaf at these positions in the log of its block,
and go on with the proof of the block in the tier above.

Tiers go up (roots) and down (proofs) by joins of one row per block. A builder and a
proof task hold one block, whatever the size of the tree; a tree with all the rows is
as many blocks as it needs.

Defined results: nulls are written as ``-`` in a leaf, so a null differs from an empty
text; rows of one id are ordered by their leaf, null ids first; equal rows are leaves
of their own; a tree of one leaf is that leaf; without siblings the proof is the hash
of nothing; an empty table has no rows and no root; other columns are not read. A null
id is never tampered with.
"""

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.ordering import with_row_numbers
from faultline.llm.common import id_text, with_values
from faultline.sources.checkpoints import checkpointed

HEIGHT = 10  # a block has at most 2 ** HEIGHT leaves
DIGEST = 64  # hex digits
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SEGMENT = "tree string, block long, n long, log binary"
PATH = "tree string, i long, path binary, subroot binary, root binary"
REPORT = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string,"
    " folded_root string, verified boolean"
)


def digest(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def leaf_hash(fields: list[Column]) -> Column:
    """Each field as its length in bytes, a colon and its text; a null as a dash."""

    def written(field):
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[written(f) for f in fields]), 256)


def height_of(leaves: int) -> int:
    """The levels above the leaves of a tree that ends in one node."""
    return (leaves - 1).bit_length()


def block_height(tree_leaves: int, height: int) -> int:
    """A block among others is raised to full height, one that is alone only to its root."""
    return min(height, height_of(tree_leaves))


def append_log(leaves: list[bytes], height: int) -> list[bytes]:
    """All nodes of a block in the order of their completion; the last one is its root."""
    log, waiting = [], []  # waiting: the nodes still without a parent, with their level
    for leaf in leaves:
        level, node = 0, leaf
        log.append(node)
        while waiting and waiting[-1][0] == level:
            level, node = level + 1, digest(waiting.pop()[1], node)
            log.append(node)
        waiting.append((level, node))
    level, node = waiting.pop()
    while level < height:
        joined = [waiting.pop()[1]] if waiting and waiting[-1][0] == level else []
        level, node = level + 1, digest(*joined, node)
        log.append(node)
    return log


def popcount(numbers: np.ndarray) -> np.ndarray:
    return np.bitwise_count(numbers.astype(np.uint64)).astype(np.int64)


def positions(level: int, numbers: np.ndarray, leaves: int) -> np.ndarray:
    """Where the nodes of a level stand in the log of a block of so many leaves."""
    last = ((numbers + 1) << level) - 1
    complete = 2 * last - popcount(last) + level
    lowest = (leaves & -leaves).bit_length() - 1  # no level up to this one needs closing
    closing = 2 * leaves - int(leaves).bit_count() + level - lowest - 1
    return np.where(last < leaves, complete, closing)


def siblings(leaves: int, height: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level: the sibling's position (-1: none) of every leaf, and whether it is on the left."""
    own = np.arange(leaves, dtype=np.int64)
    for level in range(height):
        other = (own >> level) ^ 1
        at = positions(level, other, leaves)
        yield np.where(other << level < leaves, at, -1), other < (own >> level)


def paths_in(log: bytes, leaves: int, height: int) -> list[list[tuple[str, bytes]]]:
    """For every leaf of a block, its siblings from below: the side (U: none) and the digest."""
    nodes = [log[k : k + DIGEST] for k in range(0, len(log), DIGEST)]
    out = [[] for _ in range(leaves)]
    for at, left in siblings(leaves, height):
        for path, position, on_left in zip(out, at.tolist(), left.tolist()):
            path.append(("U", b"") if position < 0 else ("L" if on_left else "R", nodes[position]))
    return out


def packed(path: list[tuple[str, bytes]]) -> bytes:
    return b"".join(side.encode() + node for side, node in path)


def unpacked(path: bytes) -> list[tuple[str, bytes]]:
    steps, at = [], 0
    while at < len(path):
        side, width = path[at : at + 1].decode(), 0 if path[at : at + 1] == b"U" else DIGEST
        steps.append((side, path[at + 1 : at + 1 + width]))
        at += 1 + width
    return steps


def fold(node: bytes, path: list[tuple[str, bytes]]) -> bytes:
    """The root that a node and its siblings lead to."""
    for side, other in path:
        node = digest(other, node) if side == "L" else digest(node, other)
    return node


def segment_writer(height: int):
    """One builder: the log of one block."""

    def write(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ordered = rows.sort_by("i")
        total = ordered["n"][0].as_py()
        leaves = [d.encode() for d in ordered["digest"].to_pylist()]
        log = b"".join(append_log(leaves, block_height(total, height)))
        return pa.table({
            "tree": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int64()),
            "n": pa.array([total], pa.int64()), "log": pa.array([log], pa.binary()),
        })

    return write


def path_reader(height: int):
    """The proofs of all leaves of each block, which go on with the proof of the block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = row["block"] << height
                count = min(1 << height, row["n"] - first)
                found = paths_in(row["log"], count, block_height(row["n"], height))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * count, pa.string()),
                        pa.array(range(first, first + count), pa.int64()),
                        pa.array([packed(p) + row["path"] for p in found], pa.binary()),
                        pa.array([row["subroot"]] * count, pa.binary()),
                        pa.array([row["root"]] * count, pa.binary()),
                    ],
                    names=["tree", "i", "path", "subroot", "root"],
                )

    return read


def root_of() -> Column:
    return F.substring("log", -DIGEST, DIGEST)


def append_logs(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The logs of all trees, tier by tier: tree, block, n, log. Leaves: tree, i, n, digest.

    One row per block. A tier has a ``2 ** height``-th of the rows of the one below;
    the last has one row per tree.
    """
    tiers = []
    while True:
        blocks = leaves.withColumn("block", F.shiftright("i", height)).select("tree", "block", "i", "n", "digest")
        logs = checkpointed(blocks.groupBy("tree", "block").applyInArrow(segment_writer(height), SEGMENT))
        tiers.append(logs)
        if logs.filter(F.col("n") > 1 << height).isEmpty():
            return tiers
        leaves = logs.select(
            "tree", F.col("block").alias("i"),
            F.shiftright(F.col("n") + ((1 << height) - 1), height).alias("n"),
            root_of().cast("string").alias("digest"),
        )


def block_proofs(tiers: list[DataFrame], top: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The logs of the lowest tier with the proof of each block: path, subroot, root.

    ``top`` has these columns for the root of every tree. Every join has one row per
    block on either side.
    """
    held = tiers[-1].join(top, "tree")
    for logs in reversed(tiers[:-1]):
        paths = held.mapInArrow(path_reader(height), PATH).withColumnRenamed("i", "block")
        held = logs.join(paths, ["tree", "block"])
    return held


def indexed_leaves(rows: DataFrame) -> DataFrame:
    """Rows with tree, doc_id, leaf as leaves: number within the tree and size of the tree."""
    numbered = with_row_numbers(rows, ["tree", "doc_id", "leaf"])
    sizes = checkpointed(
        numbered.groupBy("tree").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    )
    return with_values(numbered, sizes, "tree").withColumn("i", F.col("number") - F.col("first"))


class Manifest:
    """The logs of the trees of a dataset and of the tree over their roots."""

    def __init__(self, rows: DataFrame, height: int = HEIGHT):
        """Rows: tree (the order of the roots; never null), doc_id, leaf and what else proofs shall carry."""
        self.height = height
        self.leaves = indexed_leaves(rows)
        self.tiers = append_logs(self.leaves.select("tree", "i", "n", F.col("leaf").alias("digest")), height)
        roots = self.tiers[-1].select("tree", root_of().cast("string").alias("digest"))
        numbered = with_row_numbers(roots, ["tree"])
        count = numbered.count()
        self.roots = numbered.select("tree", "digest", (F.col("number") - 1).alias("i"))
        self.top = append_logs(
            self.roots.select(F.lit("").alias("tree"), "i", F.lit(count).cast("long").alias("n"), "digest"), height
        )

    def logs(self) -> DataFrame:
        """The manifest as one table: whole (the tree over the roots), tier, tree, block, n, log."""
        parts = [
            logs.select(F.lit(whole).alias("whole"), F.lit(tier).alias("tier"), "*")
            for whole, tiers in ((False, self.tiers), (True, self.top))
            for tier, logs in enumerate(tiers)
        ]
        return reduce(DataFrame.unionByName, parts)

    def blocks(self) -> DataFrame:
        """Every lowest log with the proof of its block up to the root of the dataset."""
        empty = F.lit(b"").cast("binary")
        whole = self.top[-1].select("tree", empty.alias("path"), empty.alias("subroot"), root_of().alias("root"))
        paths = block_proofs(self.top, whole, self.height).mapInArrow(path_reader(self.height), PATH)
        top = paths.drop("tree", "subroot").join(self.roots, "i").select(
            "tree", "path", F.col("digest").cast("binary").alias("subroot"), "root"
        )
        return block_proofs(self.tiers, top, self.height)

    def proofs(self, check, schema: str, columns: list[str]) -> DataFrame:
        """``check`` (leaf rows of a block with ``columns``, the row of the block) for every block, in parallel."""
        asked = self.leaves.select("tree", F.shiftright("i", self.height).alias("block"), "i", *columns)
        return (
            asked.groupBy("tree", "block")
            .cogroup(self.blocks().groupBy("tree", "block"))
            .applyInArrow(check, schema)
        )


def verifier(height: int):
    """Fold every leaf of a block, or what it was changed to, up to the root."""

    def verify(rows: pa.Table, held: pa.Table) -> pa.Table:
        ordered, block = rows.sort_by("i").to_pylist(), held.to_pylist()[0]
        above = unpacked(block["path"])
        tail = b"".join(node for _, node in above)
        root, rest = block["root"].decode(), {}
        proofs, folded = [], []
        paths = paths_in(block["log"], len(ordered), block_height(block["n"], height))
        for row, path in zip(ordered, paths):
            node = fold((row["changed"] or row["leaf"]).encode(), path)
            if node not in rest:  # untouched leaves of a block meet in its root
                rest[node] = fold(node, above).decode()
            proofs.append(digest(*[n for _, n in path], tail).decode())
            folded.append(rest[node])
        return pa.table({
            "doc_id": pa.array([r["doc_id"] for r in ordered], pa.int64()),
            "leaf": pa.array([r["leaf"] for r in ordered], pa.string()),
            "subroot": pa.array([block["subroot"].decode()] * len(ordered), pa.string()),
            "root": pa.array([root] * len(ordered), pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([f == root for f in folded], pa.bool_()),
        })

    return verify


def document_leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf and the leaf after tampering (null where nothing is touched).

    The tree is the language behind a sign that keeps null before the empty text.
    """
    fields = {name: F.col(name) for name in FIELDS}
    more = {**fields, "n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    tampered = F.col("doc_id").isNotNull() & (F.crc32(id_text()) % 7 == 0) & F.col("n_chars").isNotNull()
    return docs.select(
        F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_hash(list(fields.values())).alias("leaf"),
        F.when(tampered, leaf_hash(list(more.values()))).alias("changed"),
    )


def manifest_report(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per document: its leaf, the roots, its proof, and what the proof says of the row as found."""
    manifest = Manifest(document_leaves(docs), height)
    return manifest.proofs(verifier(height), REPORT, ["doc_id", "leaf", "changed"])
