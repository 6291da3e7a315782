"""Word and shingle hashes of whole texts in numpy."""

import numpy as np
import pyarrow as pa

from faultline.llm.arrow import bytes_of

SHINGLE = 5
TOKEN_BITS = 58  # of a shingle hash; the bits above are free for its place in a global order
TOKEN_MASK = np.uint64((1 << TOKEN_BITS) - 1)
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
TURN = np.uint64(pow(BASE, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
PLACE = mixed(np.arange(301, 301 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def powers(base, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    if count:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_spans(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the bytes, and the bounds of each text among the words."""
    inside = ~IS_SPACE[flat]
    before = np.zeros(len(flat), bool)
    before[1:] = inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(flat)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(flat), bool)
    after[:-1] = inside[1:]
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word (A-Z in lower case), and the bounds of each text among them."""
    flat, bounds = bytes_of(texts)
    starts, ends, words = word_spans(flat, bounds)
    rolled = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[LOWER[flat]] * powers(np.uint64(BASE), len(flat)), out=rolled[1:])
    value = (rolled[ends] - rolled[starts]) * powers(TURN, len(flat) + 1)[starts]
    return mixed(value + (ends - starts).astype(np.uint64)), words


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of every text in order, and the bounds of each text.

    A text with one to four words has its whole sequence as the only shingle.
    """
    words, bounds = word_hashes(texts)
    sizes = np.diff(bounds)
    counts = np.where(sizes >= SHINGLE, sizes - (SHINGLE - 1), np.minimum(sizes, 1))
    at = ranges(bounds[:-1], counts)
    long_enough = np.repeat(sizes >= SHINGLE, counts)
    padded = np.r_[words, np.zeros(SHINGLE, np.uint64)]
    total = np.zeros(len(at), np.uint64)
    room = np.repeat(bounds[1:], counts) - at
    for k in range(SHINGLE):
        total += np.where(room > k, padded[at + k] * PLACE[k], np.uint64(0))
    short = np.repeat(sizes, counts).astype(np.uint64) * np.uint64(BASE)
    total += np.where(long_enough, np.uint64(0), short)
    return mixed(total) & TOKEN_MASK, np.r_[0, np.cumsum(counts)]


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of every text, ascending, and the bounds of each text."""
    hashes, bounds = shingle_hashes(texts)
    order = bounds.tolist()
    sets = [np.unique(hashes[a:b]) for a, b in zip(order[:-1], order[1:])]
    sizes = [len(s) for s in sets]
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.r_[0, np.cumsum(sizes)].astype(np.int64)


def fingerprints(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of every set; zero for an empty one."""
    out = []
    for salt in (np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)):
        total = np.r_[np.uint64(0), np.cumsum(mixed(flat + salt), dtype=np.uint64)]
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def sketch(tokens: np.ndarray) -> bytes:
    """A parity sketch of a set: a bit is on when an odd number of its hashes fall on it.

    It has the next power of two of bits, 64 at least. The halves of a sketch, one laid on
    the other by exclusive or, are the sketch of half its size; two sets differ in at least
    as many hashes as their sketches of one size differ in bits.
    """
    bits = max(64, 1 << (len(tokens) - 1).bit_length())
    seen = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((seen & 1).astype(np.uint8)).tobytes()


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches, in rows of 64-bit words, brought down to a width in words."""
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words
