"""Units without a space, far longer than words, and texts longer than a piece, against the library."""

import base64
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from faultline.llm import arrow, tokens

LETTERS = "the quick brown fox jumps over lazy dog internationalization of many things while people walk".split()


@pytest.fixture(scope="module")
def tables():
    return tokens.Merges(tokens.load_model(tokens.default_model()))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokens.default_model())


def same(tables, library, texts):
    ids, bounds = tables.encode(pa.array(texts, pa.string()))
    decoded = tables.decode(ids, bounds)
    decoded.validate(full=True)
    for i, text in enumerate(texts):
        want = library.encode(text)
        assert ids[bounds[i] : bounds[i + 1]].tolist() == want
        assert decoded[i].as_py() == library.decode(want)


@pytest.mark.parametrize("size", [511, 512, 513, 40_000, 1_000_000])
def test_long_units(tables, library, size):
    rng = random.Random(size)
    texts = [
        base64.b64encode(rng.randbytes(size)).decode()[:size], " " * size, "ab" * (size // 2), "a" * size, "=-" * (size // 2),
        "".join(rng.choice(LETTERS) for _ in range(size // 6)), "日本語한국어é\U0001f600" * (size // 9),
    ]
    for text in texts:
        same(tables, library, [text])
    if size < 1000:
        same(tables, library, texts)


def test_long_and_short_units_together(tables, library):
    rng = random.Random(2)
    parts = ["a", "b", "e", "t", "th", "ing", " ", "  ", "é", "日", "\U0001f600", "\n", "0", "▁", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["".join(rng.choice(parts[:6]) for _ in range(rng.randrange(400, 1500))) + " end" for _ in range(60)]
    rng.shuffle(texts)
    same(tables, library, [*texts, "", " ", "▁"])


def test_decoding_of_any_ids(tables, library):
    """Runs of byte pieces that are no text, control and unknown ids, in front and behind marks."""
    rng = np.random.default_rng(4)
    runs = [rng.integers(0, 300, rng.integers(0, 12)).astype(np.int32) for _ in range(400)] + [np.zeros(0, np.int32)]
    runs += [np.r_[rng.integers(300, 32_000, 3), rng.integers(3, 259, 2)].astype(np.int32) for _ in range(200)]
    bounds = np.r_[0, np.cumsum([len(r) for r in runs])]
    got = tables.decode(np.concatenate(runs), bounds)
    first = [r for r in runs if not (len(r) and r[0] < 3)]
    want = {tuple(r.tolist()): library.decode(r.tolist()) for r in first}
    for text, run in zip(got.to_pylist(), runs):
        if tuple(run.tolist()) in want:
            assert text == want[tuple(run.tolist())]


def test_texts_longer_than_a_piece(tables, library):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(LETTERS) for _ in range(n)) for n in (3, 2000, 0, 9000, 1, 4000)]
    whole = pa.array([texts[0], None, *texts[1:]], pa.string())
    run = arrow.by_pieces(lambda part: pa.array([len(t) for t in part.to_pylist()]), 5000)
    assert next(run(iter([whole]))).to_pylist() == [len(t or "") for t in whole.to_pylist()]
    work = tokens.tokenizer(tokens.load_model(tokens.default_model()))
    got = next(work(iter([whole]))).to_pylist()
    for row, text in zip(got, whole.to_pylist()):
        assert row["ids"] == library.encode(text or "")
