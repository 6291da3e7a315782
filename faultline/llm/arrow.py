"""Work on Arrow batches in bounded pieces."""

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 4 << 20  # a piece holds at most so much text, or one text


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """Slices of whole texts with at most ``limit`` bytes each (a longer text is alone)."""
    if len(texts) == 0:
        return
    sizes = np.diff(offsets_of(texts))
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > limit:
            yield texts.slice(start, i - start)
            start, held = i, 0
        held += size
    yield texts.slice(start)


def offsets_of(texts: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    raw = np.frombuffer(texts.buffers()[1], dtype=width)
    return raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each text begins and ends."""
    offsets = offsets_of(texts)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return what a finished task has freed to the system: workers live on beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def by_pieces(work: Callable[[pa.Array], pa.Array], limit: int = PIECE_BYTES) -> Callable:
    """Applies ``work`` to the pieces of each batch; null texts come as empty ones."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.fill_null("") if batch.null_count else batch
            done = [work(piece) for piece in pieces(texts, limit)] or [work(texts)]
            yield pa.concat_arrays(done)
            del batch, texts, done
        give_back()

    return run
