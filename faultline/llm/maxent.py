"""Language-model scores by a hashed maximum-entropy model.

The model factors a token into its class and itself: the class of a token is
predicted by a softmax over hashed features of the words before it (the last word,
the last two, the last but one alone and the last with the last but two). Classes are
the end of a text, bands of the vocabulary with equal numbers of occurrences, and the
words outside the vocabulary. Inside its class a word is found by a binary tree whose
leaves are the words: at every node a logistic choice, with the hashed contexts of the
last word and of the last but one, each joined with the node, goes to one of two parts
of equal mass. Without weights a choice has the odds of the parts, so the choices give
the word's share of its class.
Words outside the vocabulary have their share of their class in every context.

Counts are exact over all training documents. The ``TOP`` most frequent words are
sent to the tasks; what a less frequent known word adds to a score comes by a join
on the word, so no table on a worker grows with the corpus beyond a bound.

Training runs in rounds, each over its own share of the training documents: a task
sums the gradient of its documents, the sums of all tasks are added by blocks of
buckets, in two shuffled levels where the tasks are many, and the driver holds the
weights. Sums are shuffled with eight binary digits. The number of buckets grows with
the training tokens up to ``2 ** MOST_BITS``. The step of a bucket is scaled by how often it occurred. Partitions of little text are
put together for training, so the gradients shuffled stay small beside the text.

Words are told apart by 64-bit hashes.

Defined results: a null text is an empty one, which has the end as its only token;
a null id is hashed as empty text; without training documents every token is unknown
and the class is uniform; texts that are equal get equal scores; an empty table
gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.arrow import by_pieces, give_back, pieces
from faultline.llm.common import remainder
from faultline.llm.shingles import BASE, mixed, word_hashes
from faultline.sources.checkpoints import checkpointed

HELD_OUT = (10, 0)  # divisor and remainder of the documents kept out of training
TOP = 400_000  # words in the vocabulary of the tasks
CLASSES = 16
LEVELS = 4  # of choices inside classes that share a row of weights, which is a line of a cache
INNER = 1 << LEVELS  # weights in such a row; there are as many rows as buckets
INNER_CONTEXTS = [0, 2]  # of the four: the last word and the last but one
LEAST_BITS, MOST_BITS = 12, 17  # of the number of buckets
TOKENS_A_BUCKET = 32
BLOCKS = 64  # of buckets, in which gradients are added
ROUNDS = 4
TASK_TOKENS = 8_000_000  # training tokens of a task, at least, where there are more tasks than cores
BRANCH = 32  # gradients added by a task of the first level
STEP, INNER_STEP, DAMPING = 2.0, 1.0, 1.0
SMOOTH = 0.1
PIECE = 2 << 20
STRIDE = 1 << 13  # tokens worked on at once where many values belong to a token, so that they stay in the caches
END, START = np.uint64(1), np.uint64(2)  # stand for the end of a text and for what is before it
REACHED = 0.5 ** np.floor(np.log2(np.arange(1, INNER)))  # the part of a row's tokens that come to a node, by equal halves
COLUMNS = CLASSES + 1 + INNER  # of a bucket's sums


@dataclass
class Vocabulary:
    words: np.ndarray  # ascending hashes
    classes: np.ndarray
    share: np.ndarray  # log10 of the share in its class
    base: np.ndarray  # log10 of the smoothed frequency
    end_base: float
    end_known: bool
    unknown_share: float
    unknown_base: float
    prior: np.ndarray  # natural log of the class frequencies
    depth: np.ndarray  # of each word below its class, in choices
    start: np.ndarray  # of each word's path
    path: np.ndarray  # of all words: a row of the tree, and the choices taken in it as a number of LEVELS digits
    odds: np.ndarray  # natural log of the odds to go right, for each row of the tree and node of the row
    firsts: np.ndarray  # for the upper bits of a hash, the place of the first word that is not below them

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        shift = np.uint64(64 - (len(self.firsts).bit_length() - 1))
        at = self.firsts[hashes >> shift]
        held = self.words[at]
        left = np.flatnonzero(held < hashes)
        while len(left):
            at[left] += 1
            left = left[at[left] < len(self.words)]
            held[left] = self.words[at[left]]
            left = left[held[left] < hashes[left]]
        return np.minimum(at, len(self.words) - 1), held == hashes


def first_places(words: np.ndarray) -> np.ndarray:
    """For each value of the upper bits of a hash, the place of the first of the ascending ``words`` not below it."""
    bits = max(1, len(words).bit_length())
    places = np.searchsorted(words, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    return np.minimum(places, max(0, len(words) - 1)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over whole texts, counted in each piece before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(0).fill_null(""), 4 * PIECE):
                hashes, _ = word_hashes(texts)
                words, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word long, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, texts: int) -> tuple[Vocabulary, int, DataFrame | None]:
    """The vocabulary of the tasks, the number of training tokens and the other known words."""
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, different = row[0] + texts, row[1] + bool(texts)
    top = counts.orderBy(F.desc("n"), "word").limit(TOP).toArrow()
    words = np.asarray(top["word"]).astype(np.int64).view(np.uint64)
    n = np.asarray(top["n"]).astype(np.float64)
    rest = None
    if row[1] > len(words):
        edge = int(n[-1])
        rest = counts.filter(F.col("n") <= edge).join(
            counts.sparkSession.createDataFrame(
                pa.table({"word": pa.array(words[n == edge].view(np.int64))})
            ),
            "word",
            "left_anti",
        )
    others = tokens - texts - n.sum()
    bands = CLASSES - 2
    mass = np.cumsum(n) - n / 2
    classes = 1 + np.minimum(bands - 1, (mass * bands / max(1.0, n.sum())).astype(np.int64))
    sizes = np.bincount(classes, weights=n, minlength=CLASSES)
    sizes[0], sizes[-1] = texts, others + SMOOTH
    smooth = np.log10(tokens + SMOOTH * (different + 1))
    order = np.argsort(words)
    return (
        Vocabulary(
            words[order],
            classes[order].astype(np.uint8),
            np.log10(n / np.maximum(sizes[classes], 1e-9))[order] if len(n) else n,
            (np.log10(n + SMOOTH) - smooth)[order],
            float(np.log10(texts + SMOOTH) - smooth),
            texts > 0,
            float(np.log10(SMOOTH) - np.log10(others + SMOOTH * (row[1] - len(words) + 1))),
            float(np.log10(SMOOTH) - smooth),
            np.log((sizes + 1e-3) / (sizes + 1e-3).sum()).astype(np.float32),
            *paths(n, classes, order),
            first_places(words[order]),
        ),
        int(tokens),
        rest,
    )


def trees(n: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roots, children and odds of the trees of all classes over words by falling frequency ``n``.

    A part of several words is cut where its two sides come closest to equal mass. A node
    has the number its right part begins with; the root of a single word is 0, its child too.
    """
    cum = np.r_[0.0, np.cumsum(n)]
    root, child, odds = np.zeros(CLASSES, np.int64), np.zeros(2 * len(n), np.int64), np.zeros(len(n), np.float32)
    bounds = np.searchsorted(classes, np.arange(CLASSES + 1))
    lo, hi, place, held = bounds[:-1], bounds[1:], np.arange(CLASSES), root
    while True:
        several = hi - lo > 1
        lo, hi, place = lo[several], hi[several], place[several]
        if not len(lo):
            return root, child, odds
        middle = (cum[lo] + cum[hi]) / 2
        cut = np.searchsorted(cum, middle)
        cut -= middle - cum[cut - 1] < cum[cut] - middle
        cut = np.clip(cut, lo + 1, hi - 1)
        held[place] = cut
        odds[cut] = np.log((cum[hi] - cum[cut]) / (cum[cut] - cum[lo]))
        lo, hi, place, held = np.r_[lo, cut], np.r_[cut, hi], np.r_[2 * cut, 2 * cut + 1], child


def paths(n: np.ndarray, classes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Depths and paths of the words in ``order``, and the odds in the rows of the trees.

    A row of a tree has ``LEVELS`` levels of it, the nodes of the row numbered from 1 on
    as a heap is.
    """
    root, child, odds = trees(n, classes)
    word, node = np.arange(len(n)), root[classes]
    depth, steps, tables, rows = np.zeros(len(n), np.uint8), [], [np.zeros((0, INNER), np.float32)], 0
    while True:
        word, node = word[node > 0], node[node > 0]
        if not len(word):
            break
        tops, row = np.unique(node, return_inverse=True)
        table, digits, slot = np.zeros((len(tops), INNER), np.float32), np.zeros(len(word), np.int64), np.ones(len(word), np.int64)
        for _ in range(LEVELS):
            inside, right = node > 0, (word >= node) & (node > 0)
            table[row[inside], slot[inside]] = odds[node[inside]]
            depth[word] += inside
            digits, slot = 2 * digits + right, 2 * slot + right
            node = np.where(inside, child[2 * node + right], 0)
        steps.append((word, (row + rows) * INNER + digits))
        tables.append(table)
        rows += len(tops)
    rows_of = -(-depth.astype(np.int64) // LEVELS)
    start = np.cumsum(rows_of) - rows_of
    path = np.zeros(rows_of.sum(), np.int32)
    for k, (words, step) in enumerate(steps):
        path[start[words] + k] = step
    return depth[order], start[order].astype(np.int32), path, np.vstack(tables)


def token_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts, each text closed by its end, and the bounds of the texts."""
    hashes, bounds = word_hashes(texts)
    closed = bounds + np.arange(len(bounds))
    stream = np.full(closed[-1], END, np.uint64)
    inside = np.ones(closed[-1], bool)
    inside[closed[1:] - 1] = False
    stream[inside] = hashes
    return stream, closed


def buckets_for(tokens: int) -> int:
    """A power of two that grows with the training tokens, within its bounds."""
    return 1 << min(MOST_BITS, max(LEAST_BITS, (tokens // TOKENS_A_BUCKET).bit_length()))


def contexts_of(stream: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The hashes of the four contexts of every token."""
    place = np.arange(len(stream)) - np.repeat(bounds[:-1], np.diff(bounds))

    def back(k: int) -> np.ndarray:
        moved = np.full(len(stream), START, np.uint64)
        moved[k:] = stream[:-k] if k < len(stream) else stream[:0]
        return np.where(place >= k, moved, START)

    one, two, three = back(1), back(2), back(3)
    a, b = np.uint64(BASE), np.uint64(0xD6E8FEB86659FD93)
    seen = (one * a + np.uint64(11), one * a + two * b + np.uint64(12), two * a + np.uint64(13), one * a + three * b + np.uint64(14))
    return np.stack([mixed(c) for c in seen])


def buckets_of(contexts: np.ndarray, count: int) -> np.ndarray:
    return (contexts >> np.uint64(64 - (count.bit_length() - 1))).astype(np.int64)


def features(stream: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """The buckets, of ``count``, of the four contexts of every token."""
    return buckets_of(contexts_of(stream, bounds), count)


def choices(v: Vocabulary, inner: np.ndarray, token: np.ndarray, word: np.ndarray, contexts: np.ndarray) -> Iterator[tuple]:
    """The choices that lead from the classes of words to the words, a row of ``LEVELS`` after the other.

    Gives the places of the tokens, how many of them, from the first on, make each choice,
    the choices as digits, the rows of weights of their contexts, and the odds to go
    right at all nodes of the row.
    """
    shift = np.uint32(32 - (len(inner).bit_length() - 1))
    for begin in range(0, len(token), STRIDE):
        known = word[begin : begin + STRIDE]
        depth = v.depth[known]
        order = np.argsort(np.uint8(255) - depth, kind="stable")
        alive = np.append(len(known) - np.cumsum(np.bincount(depth)), [0] * LEVELS)
        place, start = token[begin : begin + STRIDE][order], v.start[known[order]]
        seen = (contexts[:, place] >> np.uint64(32)).astype(np.uint32)
        for level in range(0, len(alive) - LEVELS, LEVELS):
            some = alive[level]
            step = v.path[start[:some] + level // LEVELS]
            tree_row = step >> LEVELS
            mark = tree_row.astype(np.uint32) * np.uint32(0x9E3779B1)
            rows = (((seen[:, :some] ^ mark) * np.uint32(0x85EBCA6B)) >> shift).astype(np.int64)
            odds = np.take(v.odds, tree_row, axis=0, mode="clip")  # without a second pass over the places
            for row in rows:
                odds += np.take(inner, row, axis=0, mode="clip")
            yield place[:some], alive[level : level + LEVELS].tolist(), step & (INNER - 1), rows, odds


def nodes_of(makers: list[int], digits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each level of a row: how many make the choice, their nodes in the row, and whether they go right."""
    for level, some in enumerate(makers):
        if some:
            yield some, (digits[:some] >> (LEVELS - level)) + (1 << level), (digits[:some] >> (LEVELS - 1 - level)) & 1


def word_chances(v: Vocabulary, inner: np.ndarray, token: np.ndarray, word: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Natural log of the chance of known words in their classes, for every token; 0 for tokens not named."""
    out = np.zeros(contexts.shape[1])
    for place, makers, digits, _, odds in choices(v, inner, token, word, contexts):
        first, odds, log = np.arange(len(place)) * INNER, odds.ravel(), np.zeros(len(place), np.float32)
        for some, node, right in nodes_of(makers, digits):
            against = odds[first[:some] + node] * (1 - 2 * right).astype(np.float32)
            log[:some] -= np.log(1 + np.exp(np.minimum(against, 80)))
        out[place] += log
    return out


def add_choices(v: Vocabulary, inner: np.ndarray, token, word, contexts, sums: np.ndarray) -> None:
    """Adds the gradient of the choices to ``sums``, and to the node 0, which no row has, how often the row occurred."""
    for place, makers, digits, rows, odds in choices(v, inner, token, word, contexts):
        first, odds = np.arange(len(place)) * INNER, odds.ravel()
        rows *= INNER
        for row in rows:
            np.add.at(sums, row, np.ones(len(row), np.float32))
        for some, node, right in nodes_of(makers, digits):
            slope = right.astype(np.float32) - 1 / (1 + np.exp(np.minimum(-odds[first[:some] + node], 80)))
            for row in rows:
                np.add.at(sums, row[:some] + node, slope)


def tables(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of the classes, a bucket a row, and those of the choices inside classes."""
    return np.ascontiguousarray(weights[:, :CLASSES]), np.ascontiguousarray(weights[:, CLASSES:])


def class_chances(weights: np.ndarray, prior: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Natural log of the class distribution of every token."""
    weights = np.ascontiguousarray(weights[:, :CLASSES])
    out = np.empty((buckets.shape[1], CLASSES), np.float32)
    for start in range(0, len(out), STRIDE):
        logits, some = out[start : start + STRIDE], buckets[:, start : start + STRIDE]
        np.take(weights, some[0], axis=0, out=logits, mode="clip")
        for row in some[1:]:
            logits += np.take(weights, row, axis=0, mode="clip")
        logits += prior
        logits -= logits.max(1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(1, keepdims=True))
    return out


def token_classes(vocabulary: Vocabulary, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, known = vocabulary.find(stream)
    classes = np.full(len(stream), CLASSES - 1, np.int64)
    classes[known] = vocabulary.classes[at[known]]
    return at, known, classes


def gradient_rows(docs: DataFrame, vocabulary, weights) -> DataFrame:
    """(block, gradient) of each task: sums over its documents and how often buckets and choices occurred."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, total, count = vocabulary.value, None, len(weights.value)
        outer, inner = tables(weights.value)
        for batch in batches:
            for texts in pieces(batch.column(0).fill_null(""), PIECE):
                stream, bounds = token_stream(texts)
                ends = bounds[1:] - 1
                at, known, classes = token_classes(v, stream)
                classes[ends], known[ends] = 0, False
                contexts = contexts_of(stream, bounds)
                buckets = buckets_of(contexts, count)
                chances = class_chances(outer, v.prior, buckets)
                slope = np.empty(chances.T.shape)  # a class is a row
                for start in range(0, len(chances), STRIDE):
                    slope[:, start : start + STRIDE] = -np.exp(chances[start : start + STRIDE]).T
                slope[classes, np.arange(len(classes))] += 1
                if total is None:
                    total = np.zeros((CLASSES + 1, count))
                    sums = np.zeros(inner.size, np.float32)
                for row in buckets:
                    for c in range(CLASSES):
                        total[c] += np.bincount(row, slope[c], count)
                    total[CLASSES] += np.bincount(row, minlength=count)
                token = np.flatnonzero(known)
                add_choices(v, inner, token, at[token], contexts[INNER_CONTEXTS], sums)
        if total is not None:
            blocks = np.hstack([total.T.astype(np.float32), sums.reshape(count, INNER)])
            yield block_rows(list(range(BLOCKS)), blocks.reshape(BLOCKS, -1, COLUMNS))
        give_back()

    return docs.select("text").mapInArrow(work, "block int, gradient binary")


def block_rows(numbers: list[int], blocks) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(numbers, pa.int32()), pa.array([halved(b) for b in blocks], pa.binary())],
        ["block", "gradient"],
    )


def halved(values: np.ndarray) -> bytes:
    """The upper halves of floats, rounded: the sums of a task are shuffled with eight binary digits."""
    raw = np.ascontiguousarray(values, np.float32).view(np.uint32)
    return ((raw + np.uint32(0x8000)) >> np.uint32(16)).astype(np.uint16).tobytes()


def doubled(raw) -> np.ndarray:
    return (np.frombuffer(raw, np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32)


def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One running sum per block, however many rows come."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = doubled(raw.as_buffer())
            if block in sums:
                sums[block] += part
            else:
                sums[block] = part.astype(np.float64)
    if sums:
        yield block_rows(list(sums), sums.values())


def summed(rows: DataFrame, count: int, tasks: int) -> np.ndarray:
    """The sums of all gradients for every bucket."""
    schema, branches = "block int, gradient binary", -(-tasks // BRANCH)
    if branches > 1:
        dealt = rows.withColumn("_branch", F.spark_partition_id() % branches).repartition("block", "_branch")
        rows = dealt.select("block", "gradient").mapInArrow(add_blocks, schema)
    out = np.zeros((BLOCKS, count // BLOCKS, COLUMNS))
    for row in rows.repartition("block").mapInArrow(add_blocks, schema).collect():  # BLOCKS rows of bounded size
        out[row.block] += doubled(row.gradient).reshape(out.shape[1:])
    return out.reshape(count, COLUMNS)


def train(docs: DataFrame, vocabulary, tokens: int) -> np.ndarray:
    """Weights after one round over each share of the training documents: of classes, then of choices, by bucket."""
    context, count = docs.sparkSession.sparkContext, buckets_for(tokens)
    tasks = max(context.defaultParallelism, tokens // TASK_TOKENS)
    weights = np.zeros((count, CLASSES + INNER), np.float32)
    share = F.floor(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) / HELD_OUT[0]) % ROUNDS
    for number in range(ROUNDS):
        sent = context.broadcast(weights)
        total = summed(gradient_rows(docs.filter(share == number).coalesce(tasks), vocabulary, sent), count, tasks)
        slopes, times, rows, inner = np.split(total, [CLASSES, CLASSES + 1, CLASSES + 2], axis=1)
        steps = [STEP * slopes / (times + DAMPING), np.zeros_like(rows), INNER_STEP * inner / (rows * REACHED + DAMPING)]
        weights = weights + np.hstack(steps).astype(np.float32)
        sent.destroy()
    return weights


OUTSIDE = pa.struct([("word", pa.int64()), ("times", pa.int64())])
SCORED = "n_tokens long, n_known long, base_score double, score double, outside array<struct<word:long,times:long>>"


def outside_words(stream: np.ndarray, bounds: np.ndarray, known: np.ndarray) -> pa.Array:
    """For every text the words that the tasks do not know, with their numbers of occurrences."""
    at = np.flatnonzero(~known)
    text = np.searchsorted(bounds, at, side="right") - 1
    order = np.lexsort((stream[at], text))
    text, word = text[order], stream[at][order]
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (word[1:] != word[:-1])
    starts = np.flatnonzero(new)
    times = np.diff(np.r_[starts, len(at)])
    pairs = pa.StructArray.from_arrays([pa.array(word[starts].view(np.int64)), pa.array(times)], fields=list(OUTSIDE))
    sizes = np.bincount(text[starts], minlength=len(bounds) - 1)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pairs)


def scorer(vocabulary, weights, all_words: bool):
    """Scores of texts; without ``all_words`` also the words that are not in the vocabulary."""

    def work(texts: pa.Array) -> pa.Array:
        v, (outer, inner) = vocabulary.value, tables(weights.value)
        names = ["n_tokens", "n_known", "base_score", "score", "outside"]
        if not len(texts):
            empty = [pa.array([], pa.int64())] * 2 + [pa.array([], pa.float64())] * 2 + [pa.array([], pa.list_(OUTSIDE))]
            return pa.StructArray.from_arrays(empty, names)
        stream, bounds = token_stream(texts)
        ends = bounds[1:] - 1
        contexts = contexts_of(stream, bounds)
        at, known, classes = token_classes(v, stream)
        base = np.full(len(stream), v.unknown_base)
        share = np.full(len(stream), v.unknown_share)
        known[ends] = False
        token = np.flatnonzero(known)
        base[known] = v.base[at[known]]
        share[known] = word_chances(v, inner, token, at[token], contexts[INNER_CONTEXTS])[known] / np.log(10)
        base[ends], share[ends], known[ends], classes[ends] = v.end_base, 0.0, v.end_known, 0
        chances = class_chances(outer, v.prior, buckets_of(contexts, len(outer)))
        picked = chances[np.arange(len(classes)), classes].astype(np.float64) / np.log(10)
        named = known.copy()
        named[ends] = True
        columns = [
            pa.array(np.diff(bounds)),
            pa.array(np.add.reduceat(known.astype(np.int64), bounds[:-1])),
            pa.array(np.add.reduceat(base, bounds[:-1])),
            pa.array(np.add.reduceat(picked + share, bounds[:-1])),
            outside_words(stream, bounds, named | all_words),
        ]
        return pa.StructArray.from_arrays(columns, names)

    run = by_pieces(work, PIECE)

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    return F.arrow_udf(apply, SCORED)


def score_report(docs: DataFrame) -> DataFrame:
    """The contract's columns of every document."""
    docs = docs.select("doc_id", "text")
    divisor, kept_out = HELD_OUT
    training = docs.filter(remainder(divisor) != kept_out)
    counts = checkpointed(word_counts(training))
    known, tokens, rest = vocabulary(counts, training.count())
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(known)
    weights = context.broadcast(train(training, sent, tokens))
    scored = docs.select(
        "doc_id",
        (remainder(divisor) == kept_out).alias("held_out"),
        F.monotonically_increasing_id().alias("_row"),
        scorer(sent, weights, rest is None)(F.col("text")).alias("s"),
    ).select("doc_id", "held_out", "_row", "s.*")
    if rest is None:
        scored = scored.withColumns({"more_known": F.lit(0).cast("long"), "more": F.lit(0.0)})
    else:
        scored = checkpointed(scored)  # the rows keep their numbers
        scored = scored.join(rare_words(scored, rest), "_row", "left").fillna({"more_known": 0, "more": 0.0})
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.col("more")).alias("base_score"),
        (F.col("score") + F.col("more")).alias("score"),
    )


def rare_words(scored: DataFrame, rest: DataFrame) -> DataFrame:
    """(_row, more_known, more): what known words outside the vocabulary add to each text.

    Words of ``rest`` are less frequent than all those of the vocabulary, so none is hot.
    """
    found = scored.select("_row", F.inline("outside")).join(rest, "word")
    gain = F.col("times") * (F.log10(F.col("n") + SMOOTH) - F.log10(F.lit(SMOOTH)))
    return found.groupBy("_row").agg(F.sum("times").alias("more_known"), F.sum(gain).alias("more"))
