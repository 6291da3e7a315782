"""SentencePiece encoding and decoding by vectorised merge rounds.

The model is a BPE with byte fallback: no piece holds the space mark behind
another character, so a text falls into units (space marks and the characters up
to the next mark) that are merged alone. A batch is cut into its different units;
their characters form one flat symbol array. A round finds the rank of every
adjacent pair, takes the smallest rank of each unit by a segmented minimum, merges
its leftmost occurrences in all units at once and compacts the array; units
without a pair leave. Where a merge could make room for a better pair, or ranks
tie, only the leftmost occurrence is merged in that round, so the order of merges
is the library's. A round passes over all symbols of a unit, so a unit of more than
``LONG`` symbols (a stretch without a space) keeps its pairs by rank and place instead
and touches the neighbours of each merge only, in the same order: its time grows with
its length times the logarithm of it.

Characters without a piece become their bytes. Decoding joins the bytes of the
pieces, turns marks into spaces and drops the one mark that encoding puts in
front.

Defined results: a null text is an empty one, which has no ids and decodes to an
empty text; a space mark character in a text is a space; unknown and control ids
decode as the library does. Rows do not depend on each other. Other columns pass
through, except one with the name of the result.
"""

from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.arrow import by_pieces

MARK = "▁"
NONE = np.iinfo(np.int32).max
POINTS = 0x110000
LONG = 512  # symbols of a unit that is merged on its own
UNKNOWN_TEXT = " ⁇ "  # fixed value: what the library decodes an unknown id to


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_model(path: str) -> tuple:
    """(piece, score, kind) of every id, read on the driver and sent with the task."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def kind(i: int) -> str:
        if model.is_byte(i):
            return "byte"
        if model.is_control(i):
            return "control"
        return "unknown" if model.is_unknown(i) else "piece"

    return tuple(
        (model.id_to_piece(i), float(model.get_score(i)), kind(i))
        for i in range(model.get_piece_size())
    )


class Merges:
    """Lookup tables of a model."""

    def __init__(self, model: tuple):
        self.ids = {p: i for i, (p, _, kind) in enumerate(model) if kind == "piece"}
        self.byte_ids = np.zeros(256, np.int32)
        for i, (p, _, kind) in enumerate(model):
            if kind == "byte":
                self.byte_ids[int(p[3:-1], 16)] = i
        scores = sorted({score for _, score, kind in model if kind == "piece"}, reverse=True)
        place = {score: n for n, score in enumerate(scores)}
        rank = {p: place[model[i][1]] for p, i in self.ids.items()}
        shared = np.bincount(list(rank.values()), minlength=len(scores)) > 1
        # symbols: the pieces by id, and every character behind them
        self.first_char = len(model)
        self.width = self.first_char + POINTS
        self.of_char = np.arange(POINTS, dtype=np.int64) + self.first_char
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.single = np.zeros(len(model), bool)  # merge only the leftmost of a round
        keys, ranks, merged = [], [], []
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                left, right = self.symbol(p[:cut]), self.symbol(p[cut:])
                if left is None or right is None:
                    continue
                keys.append(left * self.width + right)
                ranks.append(rank[p])
                merged.append(i)
                for part in (p[:cut], p[cut:]):
                    if part in rank and rank[p] <= rank[part]:
                        self.single[self.ids[part]] = True
            if shared[rank[p]]:
                self.single[i] = True
        order = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(ranks, np.int32)[order]
        self.merged = np.array(merged, np.int64)[order]
        self.next_merge = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist())))
        self.surface = [self.decoded(p, kind) for p, _, kind in model]
        self.surfaces = np.frombuffer(b"".join(self.surface), np.uint8)
        self.sizes = np.array([len(s) for s in self.surface], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.marked = np.array([kind == "piece" and p[0] == MARK for p, _, kind in model])
        self.is_byte = np.array([kind == "byte" for _, _, kind in model])

    def symbol(self, part: str):
        if part in self.ids:
            return self.ids[part]
        return int(self.of_char[ord(part)]) if len(part) == 1 else None

    @staticmethod
    def decoded(piece: str, kind: str) -> bytes:
        if kind == "byte":
            return bytes([int(piece[3:-1], 16)])
        if kind == "control":
            return b""
        return UNKNOWN_TEXT.encode() if kind == "unknown" else piece.replace(MARK, " ").encode()

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; the rank is NONE where there is no piece."""
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = self.keys[at] == wanted
        return np.where(known, self.ranks[at], NONE), self.merged[at]

    def merge_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat symbols of all units after the last merge, and how many each unit has."""
        long = [i for i, u in enumerate(units) if len(u) > LONG]
        if not long:
            return self.merge_rounds(units)
        symbols, counts = self.merge_rounds(["" if len(u) > LONG else u for u in units])
        alone = [self.merge_long(units[i]) for i in long]
        counts[long] = [len(a) for a in alone]
        owner = np.repeat(np.arange(len(units)), counts)
        mixed = np.empty(len(owner), np.int64)
        is_long = np.zeros(len(units), bool)
        is_long[long] = True
        mixed[~is_long[owner]] = symbols
        mixed[is_long[owner]] = np.concatenate(alone)
        return mixed, counts

    def merge_long(self, unit: str) -> np.ndarray:
        """The symbols of one unit: pairs in the order of rank and place, new ones in a heap."""
        symbols = self.of_char[np.frombuffer(unit.encode("utf-32-le"), np.uint32)]
        rank, _ = self.pairs(symbols[:-1], symbols[1:])
        at = np.flatnonzero(rank != NONE)
        known = np.sort((rank[at].astype(np.int64) << 32) + at)
        end, width, next_merge = len(symbols), self.width, self.next_merge
        held, after, before = array("q", symbols), array("q", range(1, end + 1)), array("q", range(-1, end - 1))
        fresh, nothing = [], (NONE, 0)

        def offer(left, right):
            """Put the pair of two places into the heap if a piece joins them."""
            found = next_merge.get(held[left] * width + held[right], nothing)[0]
            if found != NONE:
                heappush(fresh, (found << 32) + left)

        for chunk in np.split(known, range(LONG, len(known), LONG)) + [np.array([-1])]:
            for entry in chunk.tolist():
                # everything in the heap that comes before this pair goes first
                while True:
                    if fresh and (entry < 0 or fresh[0] <= entry):
                        now = heappop(fresh)
                    elif entry >= 0:
                        now, entry = entry, None
                    else:
                        break
                    left = now & 0xFFFFFFFF
                    right = after[left]
                    if held[left] >= 0 and right < end:
                        found, piece = next_merge.get(held[left] * width + held[right], nothing)
                        if found == now >> 32:
                            held[left], held[right] = piece, -1
                            behind = after[left] = after[right]
                            if behind < end:
                                before[behind] = left
                                offer(left, behind)
                            if before[left] >= 0:
                                offer(before[left], left)
                    if entry is None:
                        break
        out = np.frombuffer(held, np.int64)
        return out[out >= 0]

    def merge_rounds(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for units that are not long, all together."""
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        symbols = self.of_char[points]
        unit = np.repeat(np.arange(len(units)), [len(u) for u in units])
        done_symbols, done_units = [], []
        while len(symbols):
            inside = np.zeros(len(symbols), bool)
            inside[:-1] = unit[1:] == unit[:-1]
            rank = np.full(len(symbols), NONE, np.int32)
            piece = np.zeros(len(symbols), np.int64)
            at = np.flatnonzero(inside)
            rank[at], piece[at] = self.pairs(symbols[at], symbols[at + 1])
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            ended = best == NONE
            if ended.any():
                done_symbols.append(symbols[ended])
                done_units.append(unit[ended])
            hits = np.flatnonzero((rank == best) & ~ended)
            if not len(hits):
                break
            # among neighbours that overlap, every second one from the left
            fresh = np.r_[True, np.diff(hits) > 1]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
            chosen = (np.arange(len(hits)) - run) % 2 == 0
            first = np.r_[True, unit[hits][1:] != unit[hits][:-1]]
            alone = np.repeat(self.single[piece[hits[first]]], np.diff(np.r_[np.flatnonzero(first), len(hits)]))
            hits = hits[chosen & (first | ~alone)]
            symbols[hits] = piece[hits]
            keep = ~ended
            keep[hits + 1] = False
            symbols, unit = symbols[keep], unit[keep]
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(len(units), np.int64)
        symbols, unit = np.concatenate(done_symbols), np.concatenate(done_units)
        order = np.argsort(unit, kind="stable")
        return symbols[order], np.bincount(unit, minlength=len(units))

    def unit_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all units and the number of ids of each."""
        symbols, counts = self.merge_units(units)
        owner = np.repeat(np.arange(len(units)), counts)
        unknown = np.flatnonzero(symbols >= self.first_char)
        if not len(unknown):
            return symbols.astype(np.int32), counts
        # the few characters without a piece become their bytes
        chars = [chr(c).encode() for c in (symbols[unknown] - self.first_char).tolist()]
        repeat = np.ones(len(symbols), np.int64)
        repeat[unknown] = [len(c) for c in chars]
        ids = np.repeat(symbols, repeat).astype(np.int32)
        ids[np.repeat(symbols >= self.first_char, repeat)] = self.byte_ids[
            np.frombuffer(b"".join(chars), np.uint8)
        ]
        return ids, np.bincount(np.repeat(owner, repeat), minlength=len(units))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the bounds of each text in them."""
        spaced = pc.replace_substring(texts, MARK, " ")
        split = pc.split_pattern(spaced, " ")
        bounds = np.asarray(split.offsets, dtype=np.int64) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        code = np.asarray(coded.indices, dtype=np.int64)
        names = coded.dictionary.to_pylist()
        units = [MARK + name for name in names]
        # empty texts have no unit at all
        sizes = np.diff(bounds)
        empty_text = np.asarray(pc.equal(pc.binary_length(texts), 0), dtype=bool)
        text = np.repeat(np.arange(len(texts)), sizes)
        real = ~empty_text[text]
        code, text = code[real], text[real]
        blank = names.index("") if "" in names else -1
        if blank >= 0 and (code == blank).any():
            code, text = joined_marks(code, text, blank, units)
        ids, counts = self.unit_ids(units)
        starts = np.r_[0, np.cumsum(counts)]
        per_text = np.bincount(text, weights=counts[code], minlength=len(texts)).astype(np.int64)
        return ids[spread(starts[code], counts[code])], np.r_[0, np.cumsum(per_text)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The text of every run of ids, put together as bytes."""
        sizes = self.sizes[ids]
        flat = self.surfaces[spread(self.starts[ids], sizes)]
        ends = np.r_[0, np.cumsum(sizes)][bounds]
        # the mark in front is the one that encoding has added
        filled = bounds[1:] > bounds[:-1]
        marked = np.zeros(len(filled), bool)
        marked[filled] = self.marked[ids[bounds[:-1][filled]]]
        keep = np.ones(len(flat), bool)
        keep[ends[:-1][marked]] = False
        ends[1:] -= np.cumsum(marked)
        data = flat[keep].tobytes()
        with_bytes = np.flatnonzero(np.add.reduceat(np.r_[self.is_byte[ids], False], bounds[:-1]) * filled)
        broken = {}
        for i in with_bytes.tolist():
            try:
                data[ends[i] : ends[i + 1]].decode()
            except UnicodeDecodeError:
                text = self.decode_broken(ids[bounds[i] : bounds[i + 1]].tolist())
                broken[i] = text[1:] if marked[i] else text
        if broken:  # such bytes are no text; their places are filled anew
            texts = [broken[i].encode() if i in broken else data[a:b] for i, (a, b) in enumerate(zip(ends[:-1], ends[1:]))]
            return pa.array([t.decode() for t in texts], pa.string())
        return pa.StringArray.from_buffers(
            len(filled), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)
        )

    def decode_broken(self, ids: list[int]) -> str:
        """Runs of byte ids that are not valid UTF-8: each wrong byte is one replacement."""
        out, run = [], b""
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                size = next((n for n in range(1, 5) if valid(run[:n])), 0)
                out.append(run[:size].decode() if size else "�")
                run = run[size or 1 :]
            if i is not None:
                out.append(self.surface[i].decode())
        return "".join(out)


def valid(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def joined_marks(code, text, blank: int, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Marks in a row belong to the unit of the next characters of the text."""
    empty = code == blank
    last = np.r_[text[1:] != text[:-1], True]
    ends = np.flatnonzero(~empty | last)  # a unit ends at its characters or with the text
    before = np.diff(np.r_[-1, ends]) - 1  # blank parts in front
    code_at, text_at = code[ends], text[ends]
    odd = np.flatnonzero(before > 0)
    seen: dict[tuple[int, int], int] = {}
    for i in odd.tolist():
        key = (int(before[i]), int(code_at[i]))
        if key not in seen:
            seen[key] = len(units)
            units.append(MARK * key[0] + units[key[1]])
        code_at[i] = seen[key]
    return code_at, text_at


KEPT: dict[int, Merges] = {}


def tables(model: tuple) -> Merges:
    """Built once per Python worker and model."""
    key = hash(model)
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = Merges(model)
    return KEPT[key]


def list_of(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def tokenizer(model: tuple):
    """An Arrow function from texts to (ids, decoded)."""

    def work(texts: pa.Array) -> pa.Array:
        t = tables(model)
        ids, bounds = t.encode(texts)
        return pa.StructArray.from_arrays(
            [list_of(pa.array(ids, pa.int32()), bounds), t.decode(ids, bounds)], ["ids", "decoded"]
        )

    return by_pieces(work)


def tokenized(docs: DataFrame, path: str | None = None, column: str = "tokens") -> DataFrame:
    """Adds a struct ``column`` of the ids of each text and the text they decode to."""
    run = tokenizer(load_model(path or default_model()))

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    udf = F.arrow_udf(apply, "ids array<int>, decoded string")
    return docs.withColumn(column, udf(F.col("text")))


def token_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, number of ids and the SHA-256 of the ids and of the decoded text."""
    ids = F.array_join(F.col("tokens.ids").cast("array<string>"), ",")
    return tokenized(docs.select("doc_id", "text"), path).select(
        "doc_id",
        F.size("tokens.ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("tokens.decoded", 256).alias("decoded_sha256"),
    )
