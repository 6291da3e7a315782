"""N-gram Jaccard join by prefix trees.

A document is the set of its different five-word shingles; two documents link when
their sets have a Jaccard similarity of at least 0.8. Equal sets are one class, so
only links between different sets are searched.

Global order. Every shingle is a 64-bit number: the upper bits hold a level, the
lower ones its hash. The level is about the logarithm of how often a shingle was
seen within the chunks of one task, so shingles of passages that very many texts
share come last and the order stays a function of the shingle alone. Any level
gives right results; good ones give short candidate lists.

Prefixes. Linked sets share a shingle among their first n - ceil(0.8 n) + 1 in this
order. Each shingle met in the prefixes of two or more sets is a bucket; what the
sets have in shared prefix shingles is their list.

Links. First every set is held against the hubs it meets most often, the sets with
the largest share of shared shingles in its buckets: groups of near copies fall
together without a pair for every two of them. Then, in buckets that still hold several components,
the lists of the members form prefix trees of at most ``BLOCK`` sets and the sets
outside the largest component walk through them: a walk shares the overlap of
common branches and leaves a branch as soon as what it has met and what can follow
stay below the overlap a link needs. Sets that no other one of their bucket can link
with stay outside, by sizes and by parity sketches: sets differ in at least as many
shingles as their sketches differ in bits, so a pair whose sketches differ too much is no
link. Pairs that pass, and the pairs of the first step whose lists allow a link, are
verified with the whole sets.

Shingle hashes have 58 bits, compared within a pair only; a set is named by a 64-bit
sum over its shingles.

Defined results: A-Z are lowered, other characters stay; a text with one to four
words has its whole sequence as the one shingle; a text without words, or null,
has no set, links with nothing and is its own component; a component takes its
smallest id, and null when none of its rows has an id; rows repeated with the same
id are equal sets; an empty table gives an empty result. Only ``doc_id`` and
``text`` are read.
"""

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.arrow import by_pieces, give_back, pieces
from faultline.llm.common import settled, small_side
from faultline.llm.components import components
from faultline.llm.shingles import TOKEN_BITS, fingerprints, folded, shingle_sets, sketch
from faultline.sources.checkpoints import checkpointed

PERCENT = 80  # of the union that the intersection of linked sets has at least
SIZE_CLASSES = 20  # trees per e-fold of set size
BLOCK = 256  # sets in one prefix tree
ROWS = 256  # lists turned into Python numbers at a time
PIECE = 1 << 20  # bytes of text worked on together
CHUNK = 1_500_000  # shingles among which a task looks for frequent ones
STARS = 2  # hubs that a set is held against before the trees
LOCAL, FREQUENT = 3, 8  # sightings in a chunk and over all chunks from which a level is kept
KNOWN = 100_000  # sets a task remembers in order not to send them twice; what it forgets is merged later
LEVELS = 1_000_000  # frequent shingles that carry a level: 9 MB on every worker at most


ROW = ["_r1", "_r2"]


def prefix_length(n):
    """Shingles of a set of size n of which linked sets share one."""
    return n - (n * PERCENT + 99) // 100 + 1


def set_keys(docs: DataFrame) -> DataFrame:
    """doc_id, the size of the set and its two fingerprints."""

    def work(texts: pa.Array) -> pa.Array:
        flat, bounds = shingle_sets(texts)
        first, second = fingerprints(flat, bounds)
        columns = [np.diff(bounds), first, second]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "f", "g"])

    run = by_pieces(work, PIECE)

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    keyed = F.arrow_udf(apply, "n long, f long, g long")(F.col("text"))
    return docs.select("doc_id", *row_names(), keyed.alias("k")).select("doc_id", *ROW, "k.*")


def row_names() -> list[Column]:
    """A row by two independent hashes of its id and text."""
    return [F.xxhash64(F.lit(k), "doc_id", "text").alias(name) for k, name in enumerate(ROW)]


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    for batch in batches:
        yield from pieces(batch.column(0).fill_null(""), PIECE)
    give_back()


def frequent_shingles(docs: DataFrame) -> DataFrame:
    """(token, n): shingles that some chunks hold in several different sets."""

    def count(chunk: list[np.ndarray]) -> pa.RecordBatch:
        tokens, seen = np.unique(np.concatenate(chunk), return_counts=True)
        often = seen >= LOCAL
        return pa.RecordBatch.from_arrays(
            [pa.array(tokens[often].view(np.int64)), pa.array(seen[often].astype(np.int64))], ["token", "n"]
        )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, known = [], 0, set()
        for texts in texts_of(batches):
            flat, bounds = shingle_sets(texts)
            names, _ = fingerprints(flat, bounds)
            for name, a, b in zip(names.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                if name not in known:
                    known.add(name)
                    chunk.append(flat[a:b])
                    held += b - a
                if held >= CHUNK:
                    yield count(chunk)
                    chunk, held, known = [], 0, set()
        if chunk:
            yield count(chunk)

    found = docs.select("text").mapInArrow(local, "token long, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)


class Order:
    """Puts the level of frequent shingles in front of their hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        place = np.argsort(tokens)
        self.tokens = tokens[place].astype(np.uint64)
        level = np.clip(np.log2(np.maximum(counts[place], 2)).astype(np.uint64), 1, 31)
        self.levels = level << np.uint64(TOKEN_BITS)

    def ordered(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return tokens
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, tokens | self.levels[at], tokens)


def learned_order(docs: DataFrame) -> Order:
    top = frequent_shingles(docs).orderBy(F.desc("n"), "token").limit(LEVELS).toArrow()
    return Order(np.asarray(top["token"]).astype(np.int64).view(np.uint64), np.asarray(top["n"]))


ABOUT = pa.struct([("n", pa.int64()), ("last", pa.int64()), ("sketch", pa.binary())])


def prefix_rows(docs: DataFrame, order) -> DataFrame:
    """(token, f): prefix shingles of every set that is new to its chunk of a task.

    A row without a token tells about the set: its size, the last shingle of its prefix
    and its sketch.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for texts in texts_of(batches):
            flat, bounds = shingle_sets(texts)
            names, _ = fingerprints(flat, bounds)
            tokens = order.value.ordered(flat)
            fresh, out = [], []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                name = int(names[i])
                if a == b or name in known:
                    continue
                known.add(name)
                fresh.append(i)
                out.append(np.sort(tokens[a:b])[: prefix_length(b - a)].view(np.int64))
            if len(known) > KNOWN:
                known.clear()
            if out:
                sizes = np.diff(bounds)[fresh]
                prefixes, own = np.concatenate(out), names[fresh]
                listed = np.repeat(own, [len(x) for x in out])
                yield batch_of(pa.array(prefixes), listed, pa.nulls(len(prefixes), ABOUT))
                last = np.array([x[-1] for x in out], np.int64)
                drawn = [sketch(flat[bounds[i] : bounds[i + 1]]) for i in fresh]
                columns = [pa.array(sizes), pa.array(last), pa.array(drawn, pa.binary())]
                yield batch_of(pa.nulls(len(own), pa.int64()), own, pa.StructArray.from_arrays(columns, fields=list(ABOUT)))

    def batch_of(token: pa.Array, f: np.ndarray, about: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([token, pa.array(f), about], ["token", "f", "about"])

    return docs.select("text").mapInArrow(rows, "token long, f long, about struct<n:long,last:long,sketch:binary>")


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """The prefix rows whose shingle is in the prefixes of several sets, once each, and those about a set.

    Frequent shingles are shared by their level alone and are not brought together, nor
    are the rows about sets; the others have few sets.
    """
    frequent = F.col("token") >= (1 << TOKEN_BITS)
    alone = F.col("token").isNull() | frequent
    dealt = rows.withColumn("_part", F.when(alone, F.xxhash64("f")).otherwise(F.lit(0).cast("long")))
    bucket = Window.partitionBy("token", "_part")
    return (
        dealt.withColumn("_before", F.lag("f").over(bucket.orderBy("f")))
        .withColumn("_lowest", F.min("f").over(bucket))
        .withColumn("_highest", F.max("f").over(bucket))
        .filter("_before IS NULL OR _before <> f")
        .filter(alone | (F.col("_lowest") < F.col("_highest")))
        .select("token", "f", "about")
    )


def prefix_lists(shared: DataFrame) -> DataFrame:
    """(f, n, last, sketch, tokens): the shared prefix shingles of every set that has some, ascending."""
    listed = shared.groupBy("f").agg(
        F.sort_array(F.collect_list("token")).alias("tokens"), F.max("about").alias("about")
    )
    return listed.filter(F.size("tokens") > 0).select("f", "about.*", "tokens")


def needed(a: Column, b: Column) -> Column:
    """The least intersection that links sets of sizes a and b."""
    return F.ceil((a + b) * PERCENT / (100 + PERCENT))


def rest_after(n: Column) -> Column:
    """Shingles of a set behind its prefix."""
    return F.floor((n * PERCENT + 99) / 100) - 1


def star_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): every set with the hubs of its buckets that it meets most often, ``STARS`` at most.

    The hub of a bucket is its set with the largest share of shared shingles. A set of a
    large group of near copies meets the hub of the group in most of its buckets, so the
    pairs are as many as the sets, however large the groups are; what they leave open is
    for the trees.
    """
    weight = F.size("tokens") / (F.col("n") - rest_after(F.col("n")))
    shared = lists.select("f", weight.alias("w"), F.explode("tokens").alias("token"))
    hubs = shared.groupBy("token").agg(F.max(F.struct("w", "f"))["f"].alias("hub"))
    met = shared.select("token", "f").join(hubs, "token").filter("f <> hub").groupBy("f", "hub").count()
    most = Window.partitionBy("f").orderBy(F.desc("count"), "hub")  # as many rows as a prefix has shingles, at most
    pairs = met.withColumn("_place", F.row_number().over(most)).filter(F.col("_place") <= STARS)
    return pairs.select(F.least("f", "hub").alias("a"), F.greatest("f", "hub").alias("b")).distinct()


def possible(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs whose sizes and lists allow a link.

    Sizes alone decide for most pairs; only the others fetch their lists.
    """

    def side(columns: list[str], name: str) -> DataFrame:
        renamed = [F.col(c).alias(f"{c}_{name}") for c in columns]
        return sized.select(F.col("f").alias(name), *renamed)

    sized = lists.withColumn("size", F.size("tokens"))
    narrow = ["n", "last", "size"]
    # what is behind the prefix that ends first bounds the rest of the intersection
    rest = F.when(F.col("last_a") <= F.col("last_b"), rest_after(F.col("n_a"))).otherwise(rest_after(F.col("n_b")))
    wanted = needed(F.col("n_a"), F.col("n_b")) - rest
    screened = (
        pairs.join(side(narrow, "a"), "a")
        .join(side(narrow, "b"), "b")
        .filter(F.col("n_a") * 100 >= F.col("n_b") * PERCENT)
        .filter(F.col("n_b") * 100 >= F.col("n_a") * PERCENT)
        .select("a", "b", wanted.alias("wanted"), F.least("size_a", "size_b").alias("most"))
        .filter("most >= wanted")
        .drop("most")
    )
    met = F.size(F.array_intersect("tokens_a", "tokens_b"))
    listed = screened.join(side(["tokens"], "a"), "a").join(side(["tokens"], "b"), "b")
    return listed.filter(met >= F.col("wanted")).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("f").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("f").alias("b"), F.col("tokens").alias("right"))
    common = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - common
    return pairs.join(left, "a").join(right, "b").filter(common * 100 >= union * PERCENT).select("a", "b")


def whole_sets(docs: DataFrame, keys: DataFrame, names: DataFrame, order) -> DataFrame:
    """(f, tokens) of the named sets, from one document each; ``names`` is stored."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in texts_of(batches):
            flat, bounds = shingle_sets(texts)
            first, _ = fingerprints(flat, bounds)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(first), lists], ["f", "tokens"])

    names = small_side(names)
    chosen = keys.join(names, "f", "left_semi").groupBy("f").agg(
        F.min(F.col("doc_id").cast("long")).alias("_id")
    )
    ids = chosen.select("_id", F.lit(False).alias("_none")).filter("_id IS NOT NULL")
    ids = ids.unionByName(chosen.filter("_id IS NULL").select(F.lit(0).cast("long").alias("_id"), F.lit(True).alias("_none"))).distinct()
    read = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), "text"
    ).join(small_side(checkpointed(ids)), ["_id", "_none"], "left_semi")
    # not a column function: a filter on its result would be tried on every document, before the join
    made = read.select("text").mapInArrow(sets, "f long, tokens array<long>")
    return made.join(names, "f", "left_semi").dropDuplicates(["f"])


def tree_pairs(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): pairs of different components that a walk through the prefix trees lets pass."""
    label = F.coalesce("label", "f")
    named = checkpointed(
        lists.join(labels.withColumnRenamed("node", "f"), "f", "left").withColumn("label", label)
    )
    placed = named.select(
        "f", "n", "last", "label", F.size("tokens").alias("_size"), F.posexplode("tokens").alias("_place", "token")
    ).select("token", "f", "n", "last", (F.col("_size") - F.col("_place")).alias("left"), "label")
    by_label = placed.groupBy("token", "label").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("f")).alias("x"),
        F.bit_xor(F.xxhash64("f", F.lit(1))).alias("y"),
    )
    open_ = (
        by_label.groupBy("token")
        .agg(
            F.count("*").alias("labels"),
            F.sum("n").alias("sets"),
            F.max(F.struct("n", "label"))["label"].alias("major"),
            F.bit_xor("x").alias("x"),
            F.bit_xor("y").alias("y"),
        )
        .filter("labels > 1")
        # buckets with the same sets are one: that of the smallest shingle, which is also
        # the first common one of the pairs that have any other of them as their first
        .groupBy("sets", "x", "y")
        .agg(F.min("token").alias("token"), F.min("major").alias("major"))
        .select("token", "major", F.ceil(F.col("sets") / BLOCK).cast("int").alias("blocks"))
    )
    inside = placed.join(open_, "token")
    own = F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int")
    # a set is a member of its own block and, outside the largest component, walks through all of them
    walked = F.when(F.col("label") != F.col("major"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    narrow = ["f", "label", "n", "last", "left"]
    rows = inside.select("token", own.alias("_own"), F.explode(F.concat(F.array(F.lit(-1)), walked)).alias("_walk"), *narrow)
    walks = F.col("_walk") >= 0
    sized = rows.select(
        "token", F.when(walks, F.col("_walk")).otherwise(F.col("_own")).alias("block"), walks.alias("walks"), *narrow
    )
    screened = by_group(sized).mapInArrow(screen_groups, SCREENED)
    sketched = by_group(screened.join(named.select("f", "sketch"), "f").select(*columns_of(SCREENED), "sketch"))
    screened = checkpointed(sketched.mapInArrow(screen_groups, SCREENED))
    listed = screened.drop("left").join(named.select("f", "tokens", "sketch"), "f")
    whole = listed.select("token", "block", "walks", "f", "label", "n", "last", "tokens", "sketch")
    return by_group(whole).mapInArrow(walk_groups, "a long, b long").distinct()


def by_group(rows: DataFrame) -> DataFrame:
    """The rows of a bucket and block together, members before walkers."""
    return rows.repartition("token", "block").sortWithinPartitions("token", "block", "walks")


def columns_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


SCREENED = "token long, block int, walks boolean, f long, label long, n long, last long, left int"


def screen_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sorted groups that have a partner by sizes, what is left of both lists and, if they have them, sketches.

    Only these fetch sketches and then lists. A group has few members; walkers pass one by one.
    """

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * 4, pa.int32()]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, columns_of(SCREENED))

    here, screen, out = None, Screen(), []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for row in zip(*columns):
            if row[:2] != here:
                out += screen.needed_members()
                here, screen = row[:2], Screen()
            if not row[2]:
                screen.members.append(row)
            elif screen.has_partner(row):
                out.append(row[:8])
        if len(out) > 10_000:
            yield batch_of(out)
            out = []
    out += screen.needed_members()
    if out:
        yield batch_of(out)


class Screen:
    """The members of a group, as rows of ``screen_groups``."""

    def __init__(self):
        self.members: list[tuple] = []
        self.table, self.used, self.sketches = None, None, None

    def has_partner(self, row: tuple) -> bool:
        if not self.members:
            return False
        sketched = len(row) > 8
        if self.table is None:
            self.table = np.array([r[4:8] for r in self.members], np.int64).T
            self.used = np.zeros(len(self.members), bool)
            if sketched:
                self.sketches = by_width([words_of(r[8]) for r in self.members])
        label, n, last, left = self.table
        own_label, own_n, own_last, own_left = row[4:8]
        behind = np.where(own_last <= last, own_n, n)
        wanted = -(-(own_n + n) * PERCENT // (100 + PERCENT))
        good = (label != own_label) & (n * 100 >= own_n * PERCENT) & (n * PERCENT <= own_n * 100)
        good &= np.minimum(left, own_left) + (behind * PERCENT + 99) // 100 - 1 >= wanted
        if sketched and good.any():
            own = words_of(row[8])
            for at, words in self.sketches:
                chosen = good[at]
                some = at[chosen]
                width = min(words.shape[1], len(own))
                apart = np.bitwise_count(folded(words[chosen], width) ^ folded(own, width)).sum(axis=1, dtype=np.int64)
                good[some] = apart <= most_apart(own_n + n[some])
        self.used |= good
        return bool(good.any())

    def needed_members(self) -> list[tuple]:
        return [] if self.used is None else [r[:8] for r, u in zip(self.members, self.used) if u]


def words_of(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, np.uint64)


def by_width(sketches: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sketches of each width, with their places."""
    widths = np.array([len(s) for s in sketches])
    return [(at, np.array([sketches[i] for i in at])) for at in (np.flatnonzero(widths == w) for w in np.unique(widths))]


def bits_apart(a: tuple[int, int], b: tuple[int, int]) -> int:
    """Bits in which two sketches, as numbers with their sizes in bits, differ at the smaller size."""
    (a, size), (b, other) = sorted((a, b), key=lambda s: s[1])
    while other > size:
        other //= 2
        b = (b >> other) ^ (b & ((1 << other) - 1))
    return (a ^ b).bit_count()


def most_apart(sizes):
    """Shingles that linked sets differ in at most, by the sum of their sizes."""
    return sizes * (100 - PERCENT) // (100 + PERCENT)


def walk_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks group after group of rows sorted by bucket and block, members before walkers."""
    here, tree, out = None, None, []
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        columns = [batch.column(k).to_pylist() for k in range(9)]
        for token, block, walks, f, label, n, last, tokens, sketch in zip(*columns):
            drawn = int.from_bytes(sketch), 8 * len(sketch)
            if (token, block) != here:
                here, tree = (token, block), Tree()
            if not walks:
                tree.add(f, label, n, last, tokens, drawn)
            else:
                out += [(min(f, g), max(f, g)) for g in tree.walk(token, f, label, n, last, tokens, drawn)]
        if out:
            pairs = sorted(set(out))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"]
            )
            out = []


class Tree:
    """Prefix trees of the ordered shingle lists of a bucket.

    There is one tree for each class of set sizes, since the overlap that a link
    needs beyond the prefixes depends on both sizes.
    """

    def __init__(self):
        self.roots: dict[int, list] = {}

    def add(self, f: int, label: int, n: int, last: int, tokens: list[int], drawn: tuple[int, int]) -> None:
        at = self.roots.setdefault(int(SIZE_CLASSES * math.log(n)), new_node(n))
        for depth, token in enumerate(tokens):
            widen(at, n, len(tokens) - depth)
            branch = at[0].get(token)
            if branch is None:
                branch = at[0][token] = new_node(n)
            at = branch
        widen(at, n, 0)
        at[1].append((f, label, n, last, drawn))

    def walk(
        self, bucket: int, f: int, label: int, n: int, last: int, tokens: list[int], drawn: tuple[int, int]
    ) -> list[int]:
        """Sets of other components whose list and sketch may belong to a link with this one.

        A pair is looked at in the bucket of its first common shingle only, so a branch
        that meets an own shingle before the bucket's is left.
        """
        place = {token: k for k, token in enumerate(tokens)}
        size_of = len(tokens)
        found = []
        # node, met so far, own shingles that can still be met
        stack = [(root, 0, size_of - place[bucket]) for root in self.roots.values()]
        while stack:
            node, met, left = stack.pop()
            branches, sets, way, least, most = node
            if most * 100 < n * PERCENT or least * PERCENT > n * 100:
                continue
            if met + min(way, left) < least_met(n, least, most):
                continue
            for g, other, size, end, other_drawn in sets:
                if other == label or g == f:
                    continue
                if size * 100 < n * PERCENT or size * PERCENT > n * 100:
                    continue
                behind = n if last <= end else size
                wanted = -(-(n + size) * PERCENT // (100 + PERCENT))
                if met + (behind * PERCENT + 99) // 100 - 1 < wanted:
                    continue
                if bits_apart(drawn, other_drawn) <= most_apart(n + size):
                    found.append(g)
            for token, branch in branches.items():
                k = place.get(token)
                if token < bucket:
                    if k is None:
                        stack.append((branch, met, left))
                elif k is None:
                    stack.append((branch, met, size_of - bisect_left(tokens, token)))
                else:
                    stack.append((branch, met + 1, size_of - k - 1))
        return found


def new_node(n: int) -> list:
    """Branches, sets that end here, the longest way down, the smallest and largest set below."""
    return [{}, [], 0, n, n]


def widen(node: list, n: int, way: int) -> None:
    node[2], node[3], node[4] = max(node[2], way), min(node[3], n), max(node[4], n)


def least_met(n: int, least: int, most: int) -> float:
    """What the lists of a set of size n and any of least to most shingles must share at least."""
    share, rest = PERCENT / (100 + PERCENT), PERCENT / 100
    low = min(max(least, n * rest), n)  # below n a smaller set needs less,
    high = max(min(most, n / rest), n)  # above n a larger one
    return min(share * (n + low) - rest * n, share * (n + high) - rest * high) - 1e-6


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys of all documents, and the component label of every set that has a link."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    keys = checkpointed(set_keys(docs))
    order = spark.sparkContext.broadcast(learned_order(docs))
    shared = shared_prefixes(prefix_rows(docs, order))
    lists = checkpointed(prefix_lists(shared))
    first = settled(possible(star_pairs(lists), lists))
    sets = checkpointed(whole_sets(docs, keys, ends_of(first), order))
    links = settled(verified(first, sets))
    labels = components(links)
    second = settled(tree_pairs(lists, labels))
    more = checkpointed(whole_sets(docs, keys, ends_of(second), order))
    links = settled(links.unionByName(verified(second, more)))
    return keys, components(links)


def ends_of(pairs: DataFrame) -> DataFrame:
    return settled(pairs.select(F.explode(F.array("a", "b")).alias("f")).distinct())


def join_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    keys, labels = labelled(docs)
    labels = labels.withColumnRenamed("node", "f")
    classes = keys.filter("n > 0").groupBy("f").agg(F.min("doc_id").alias("_lowest"))
    named = checkpointed(
        classes.join(labels, "f", "left").select("f", F.coalesce("label", "f").alias("label"), "_lowest")
    )
    lowest = named.groupBy("label").agg(F.min("_lowest").alias("component_id"))
    of_set = named.join(lowest, "label").select("f", "component_id")
    return keys.join(of_set, "f", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of one document of every component: that with the smallest id, null ids last.

    Rows equal in id and text are one document. Documents without a word stay.
    """
    keys, labels = labelled(docs)
    place = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), *ROW)
    classes = keys.filter("n > 0").groupBy("f").agg(F.min(place).alias("_place"))
    named = classes.join(labels.withColumnRenamed("node", "f"), "f", "left").select(
        F.coalesce("label", "f").alias("label"), "_place"
    )
    chosen = named.groupBy("label").agg(F.min("_place").alias("_place")).select(*[f"_place.{c}" for c in ROW])
    stay = checkpointed(chosen.unionByName(keys.filter("n = 0").select(*ROW)).distinct())
    once = Window.partitionBy(*ROW).orderBy(ROW[0])
    rows = docs.select(F.struct("*").alias("_row"), *row_names()).join(stay, ROW, "left_semi")
    return rows.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select("_row.*")
