"""The Merkle manifest against a tree built level by level."""

import zlib
from hashlib import sha256

import numpy as np
import pytest

from faultline.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _part string, tree long, number long"
ODD = [
    (1, None, "en", "a", 0, "x", 1, 1), (2, "", "", None, 0, None, 2, 1), (3, "é日本\U0001f600", None, "a", 4, "y", 3, 1),
    (4, "one two", "en", "b", 7, "z", None, 1), (4, "one two", "en", "b", 7, "z", None, 1), (4, "other", "en", "b", 7, "z", None, 1),
    (None, "one two", "en", "b", 7, "z", None, 1), (None, None, None, None, None, None, None, None),
    (5, "a b c d e f g " * 100_000, "en", "b", None, None, 5, 1), (6, "42", "é", "c", 2**63 - 1, None, 6, 1),
    (-7, "x", "ｚ", "c", -1, None, 6, 1), (26, "x", "\U0001f600", "c", 5, None, 6, 1),
]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    fields = (r[f] for f in ("doc_id", "source", "lang", "n_chars", "text"))
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def beside(tree, place):
    """(on the left, digest) of the sibling on every level; None where there is none."""
    out = []
    for nodes in tree[:-1]:
        other = place ^ 1
        out.append((other < place, nodes[other]) if other < len(nodes) else None)
        place >>= 1
    return out


def brute_force(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for rows in trees.values():
        rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    built = {lang: levels([leaf(r) for r in trees[lang]]) for lang in order}
    top = levels([built[lang][-1][0] for lang in order]) if order else None
    out = []
    for n, lang in enumerate(order):
        for place, r in enumerate(trees[lang]):
            path, shown = beside(built[lang], place) + beside(top, n), dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                shown["n_chars"] += 1
            node = leaf(shown)
            for other in path:
                node = h(node) if other is None else h(other[1], node) if other[0] else h(node, other[1])
            proof = h(*[other[1] for other in path if other])
            out.append((r["doc_id"], leaf(r), built[lang][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("height,count", [(10, 200), (2, 200), (1, 9), (3, 1), (10, 0)])
def test_report_equals_brute_force(spark, height, count):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(count)
    got = sorted([tuple(r) for r in merkle.manifest_report(docs, height).collect()], key=str)
    assert got == brute_force([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("height", [10, 1])
def test_odd_rows(spark, height):
    docs = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    got = sorted([tuple(r) for r in merkle.manifest_report(docs, height).collect()], key=str)
    assert got == brute_force([dict(zip(docs.columns, r)) for r in ODD])


def test_many_trees(spark):
    """More trees than a block has leaves, each a single leaf."""
    rows = [(i, "x", f"lang{i % 70}", "s", i) for i in range(75)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted([tuple(r) for r in merkle.manifest_report(docs, 2).collect()], key=str)
    assert got == brute_force([dict(zip(docs.columns, r)) for r in rows])


@pytest.mark.parametrize("leaves", [1, 2, 3, 6, 7, 8, 13, 64, 65])
def test_positions_address_the_log(leaves):
    """The closed form finds every node of every level where the builder has put it."""
    for height in {merkle.height_of(leaves), merkle.height_of(leaves) + 2}:
        log = merkle.append_log([str(k).encode() for k in range(leaves)], height)
        nodes, found = [str(k).encode() for k in range(leaves)], []
        for level in range(height + 1):
            at = merkle.positions(level, np.arange(len(nodes)), leaves)
            assert [log[p] for p in at] == nodes
            found.extend(at.tolist())
            nodes = [merkle.digest(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        assert sorted(found) == list(range(len(log)))


def test_logs_hold_every_node_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    manifest = merkle.Manifest(merkle.document_leaves(docs), 3)
    logs = manifest.logs().collect()
    assert sum(len(r.log) // 64 for r in logs if not r.whole and r.tier == 0) >= 2 * docs.count() - len({r.tree for r in logs}) * 8
    assert all(len(r.log) // 64 <= 2 * 8 + 3 for r in logs)


def test_a_changed_row_fails_its_proof_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = queries.QUERIES["op13_manifest"](spark, "/root/testdata/sf0.001").collect()
    touched = {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 0}
    assert {r.doc_id for r in rows if not r.verified} == touched and touched
