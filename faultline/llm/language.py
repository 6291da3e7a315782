"""Language identification by a byte convolutional network.

A window is 256 bytes of the UTF-8 text. Every byte has a learned vector;
filters of widths 2, 3 and 4 slide over the window, the largest response of each
filter passes a rectifier, and a softmax over the languages follows. The network
is trained in numpy with Adam on windows spread over whole labelled texts.

For prediction the vectors and filters are folded into tables: a filter of width
4 is the sum of two table rows, each addressed by a pair of bytes. A text is cut
into windows from end to end, in fixed-length blocks of windows; the mean log
probability over the windows, weighted by their bytes, gives the language.

What is learned comes from a bounded sample: at most ``PER_LANGUAGE`` documents of
a language, at most ``MAX_ROWS`` in all, chosen by hashes of the id, with ``WINDOWS``
windows each, so the driver holds a few megabytes at any table size.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is
every text when no row has a label to learn from; rows without a label are
predicted and not learned from; ties go to the language first in code point
order. Rows do not depend on each other. Other columns pass through, except one
with the name of the result.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.arrow import by_pieces, bytes_of
from faultline.llm.common import id_text, remainder, small_side
from faultline.sources.checkpoints import checkpointed

WINDOW = 256
WIDTHS = (2, 3, 4)
VECTOR, FILTERS = 8, 8
PER_LANGUAGE, MAX_ROWS, WINDOWS = 300, 20_000, 4
BLOCK = 512  # windows evaluated together
HELD_OUT = (3, 1)  # divisor and remainder of the documents kept out of training
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    vectors: np.ndarray  # 256 x VECTOR
    filters: list[np.ndarray]  # width * VECTOR x FILTERS
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray


def sample_windows(docs: DataFrame) -> DataFrame:
    """(lang, window): the training windows as text.

    A language with many documents is thinned by a hash of the id to about twice the
    bound before the exact choice, so the choice never gathers a whole language.
    """
    divisor, kept_out = HELD_OUT
    labelled = docs.filter(F.col("lang").isNotNull() & (remainder(divisor) != kept_out))
    totals = checkpointed(labelled.groupBy("lang").agg(F.count("*").alias("_total")))
    chance = F.pmod(F.xxhash64(F.lit("lang"), id_text()), F.lit(1 << 31)) / F.lit(float(1 << 31))
    step = F.greatest(F.lit(1), F.floor(F.length("text") / WINDOWS)).cast("int")
    starts = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda i: i * step + 1),
        lambda at: at <= F.length("text"),
    )
    first = Window.partitionBy("lang").orderBy("_order", "_windows")
    return (
        labelled.join(small_side(totals), "lang")
        .filter(chance * F.col("_total") < 2 * PER_LANGUAGE)
        .filter(F.col("text").rlike(r"\p{L}"))
        .select(
            "lang",
            F.md5(F.concat(F.lit("lang:"), id_text())).alias("_order"),
            F.transform(starts, lambda at: F.substring("text", at, WINDOW)).alias("_windows"),
        )
        .withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= PER_LANGUAGE)
        .orderBy("_n", "_order")
        .limit(MAX_ROWS)
        .select("lang", F.explode("_windows").alias("window"))
    )


def padded(texts: list[bytes]) -> np.ndarray:
    reach = WINDOW + max(WIDTHS) - 1
    out = np.zeros((len(texts), reach), np.uint8)
    for row, raw in zip(out, texts):
        raw = raw[:WINDOW]
        row[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def train(windows: list[tuple[str, str]], epochs: int = 4, batch: int = 64, seed: int = 5) -> Network:
    languages = sorted({lang for lang, _ in windows})
    label = np.array([languages.index(lang) for lang, _ in windows])
    data = padded([text.encode() for _, text in windows])
    rng = np.random.default_rng(seed)
    params = [
        rng.normal(0, 0.5, (256, VECTOR)),
        *[rng.normal(0, 1 / np.sqrt(w * VECTOR), (w * VECTOR, FILTERS)) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS)),
        rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(languages))),
        np.zeros(len(languages)),
    ]
    params = [p.astype(np.float32) for p in params]
    params[0][0] = 0  # padding
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            gradients = gradient(params, data[rows], label[rows])
            step += 1
            for p, g, m, s in zip(params, gradients, mean, square):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
            params[0][0] = 0
    count = len(WIDTHS)
    return Network(languages, params[0], params[1 : 1 + count], *params[1 + count :])


def gradient(params: list[np.ndarray], data: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy of a batch of windows."""
    vectors, filters = params[0], params[1 : 1 + len(WIDTHS)]
    bias, dense, offset = params[1 + len(WIDTHS) :]
    seen = vectors[data]
    best, patches = [], []
    for width, weights in zip(WIDTHS, filters):
        view = np.lib.stride_tricks.sliding_window_view(data, width, axis=1)[:, :WINDOW]
        stacked = np.concatenate([seen[:, j : j + WINDOW] for j in range(width)], axis=2)
        response = stacked.reshape(-1, width * VECTOR) @ weights
        place = response.reshape(len(data), WINDOW, FILTERS).argmax(1)
        best.append(np.take_along_axis(response.reshape(len(data), WINDOW, FILTERS), place[:, None], 1)[:, 0])
        row = np.arange(len(data))[:, None]
        patches.append((stacked[row, place], view[row, place]))
    pooled = np.concatenate(best, 1) + bias
    active = np.maximum(pooled, 0)
    logits = active @ dense + offset
    logits -= logits.max(1, keepdims=True)
    chance = np.exp(logits)
    chance /= chance.sum(1, keepdims=True)
    chance[np.arange(len(label)), label] -= 1
    chance /= len(label)
    back = (chance @ dense.T) * (pooled > 0)
    to_vectors = np.zeros_like(vectors)
    to_filters = []
    for n, (width, weights) in enumerate(zip(WIDTHS, filters)):
        part = back[:, n * FILTERS : (n + 1) * FILTERS]
        patch, raw = patches[n]
        to_filters.append(np.einsum("bfk,bf->kf", patch, part))
        flow = (part[:, :, None] * weights.T).reshape(*part.shape, width, VECTOR)
        np.add.at(to_vectors, raw, flow)
    return [to_vectors, *to_filters, back.sum(0), active.T @ chance, chance.sum(0)]


class Folded:
    """Tables addressed by one byte or a pair of bytes."""

    def __init__(self, network: Network):
        self.network = network
        self.parts = []  # per width: (shift, table over pairs or bytes)
        pair = np.arange(65536)
        for width, weights in zip(WIDTHS, network.filters):
            single = [network.vectors @ weights[j * VECTOR : (j + 1) * VECTOR] for j in range(width)]
            tables = []
            for j in range(0, width - 1, 2):
                tables.append((j, (single[j][pair & 255] + single[j + 1][pair >> 8]).astype(np.float32)))
            if width % 2:
                tables.append((width - 1, single[width - 1][pair & 255].astype(np.float32)))
            self.parts.append(tables)

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Log probabilities of each window of a flat array of whole windows and its tail."""
        count = (len(data) - max(WIDTHS)) // WINDOW
        pairs = data[:-1].astype(np.int32) | (data[1:].astype(np.int32) << 8)
        pooled = []
        for tables in self.parts:
            total = None
            for shift, table in tables:
                rows = np.take(table, pairs[shift : shift + count * WINDOW], axis=0)
                total = rows if total is None else np.add(total, rows, out=total)
            held = total.reshape(count, WINDOW, FILTERS)
            size = WINDOW
            while size > 1:
                size //= 2
                held = np.maximum(held[:, :size], held[:, size : 2 * size])
            pooled.append(held[:, 0])
        n = self.network
        active = np.maximum(np.concatenate(pooled, 1) + n.bias, 0)
        logits = active @ n.dense + n.offset
        logits = logits - logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score of each text."""
        flat, bounds = bytes_of(texts)
        sizes = np.diff(bounds)
        counts = np.maximum(1, -(-sizes // WINDOW))
        firsts = np.r_[0, np.cumsum(counts)]
        data = np.zeros(firsts[-1] * WINDOW + max(WIDTHS), np.uint8)
        place = np.arange(len(flat)) + np.repeat(firsts[:-1] * WINDOW - bounds[:-1], sizes)
        data[place] = flat
        logs = np.concatenate(
            [
                self.windows(data[at * WINDOW : min(at + BLOCK, firsts[-1]) * WINDOW + max(WIDTHS)])
                for at in range(0, firsts[-1], BLOCK)
            ]
        )
        weight = np.full(firsts[-1], WINDOW, np.float64)
        weight[firsts[1:] - 1] = sizes - (counts - 1) * WINDOW
        weight = np.maximum(weight, 1e-9)[:, None]
        total = np.add.reduceat(weight, firsts[:-1])
        mean = np.add.reduceat(logs * weight, firsts[:-1]) / total
        best = mean.argmax(1)
        chance = np.add.reduceat(np.exp(logs) * weight, firsts[:-1]) / total
        return best, np.clip(chance[np.arange(len(best)), best], 0, 1)


def predictor(network: Network):
    folded: list[Folded] = []  # built once per task

    def work(texts: pa.Array) -> pa.Array:
        if not folded:
            folded.append(Folded(network))
        if len(texts) == 0:
            best, score = np.zeros(0, np.int64), np.zeros(0)
        else:
            best, score = folded[0].predict(texts)
        names = pa.array([network.languages[i] for i in best.tolist()], pa.string())
        return pa.StructArray.from_arrays([names, pa.array(score, pa.float64())], ["lang_pred", "score"])

    run = by_pieces(work)

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    return F.arrow_udf(apply, "lang_pred string, score double")


def learn(docs: DataFrame) -> Network | None:
    windows = [(r.lang, r.window) for r in sample_windows(docs).collect()]
    return train(windows) if windows else None


def identified(docs: DataFrame, network: Network | None, column: str = "language") -> DataFrame:
    """Adds a struct of the predicted language and its score."""
    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if network is None:
        return docs.withColumn(column, none)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(column, predictor(network)(F.col("text"))).withColumn(
        column, F.when(letters, F.col(column)).otherwise(none)
    )


def language_report(docs: DataFrame) -> DataFrame:
    network = learn(docs)
    divisor, kept_out = HELD_OUT
    return identified(docs.select("doc_id", "text"), network).select(
        "doc_id", (remainder(divisor) == kept_out).alias("held_out"), "language.*"
    )
