"""The stages of the corpus pipeline, each against brute force on the rows of the one before."""

import random
import re
from collections import Counter, defaultdict

import pytest
import sentencepiece

import corpus_pipeline
from faultline.llm import mixing, tokens
from tests.llm.test_queries_shape import SCHEMA, brute_components, lowered


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(3, 8))) for _ in range(n))


def fixture():
    rng = random.Random(5)
    lines = [prose(rng, 12) for _ in range(60)]
    texts = ["\n".join(lines[4 * k : 4 * k + 4]) for k in range(8)]  # 48 words each
    texts += ["\n".join([*lines[40:46], prose(rng, 9)]), "\n".join([prose(rng, 7), *lines[40:46], prose(rng, 8)])]
    texts += ["\n".join(lines[40:46])]  # all of it is in the texts before
    texts += [texts[0], texts[1] + " more", texts[2]]  # copies and a near copy, shorter than a run
    texts += [None, "", " \t\n ", "42 17", "%% !!"]
    rows = [(i, t, None, "ab"[i % 2], len(t or ""), None, i) for i, t in enumerate(texts)]
    rows += [(3, texts[3], None, "b", len(texts[3]), None, 3)]  # a repeated row
    return [*rows, (None, prose(rng, 20), None, None, None, None, None)]


@pytest.fixture
def stages(spark, tmp_path):
    def run(rows):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/in/documents.parquet")
        found, docs = {"in": rows}, spark.read.parquet(f"{tmp_path}/in/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, f"{tmp_path}/in").write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            found[name] = docs.collect()
        return found, f"{tmp_path}/in"

    return run


def pairs(rows):
    return Counter((r[0], r[1]) for r in rows)


def without_runs(rows):
    """The texts without lines of runs of 50 words that are in an earlier place; rows in order of their ids."""
    seq = [(k, line) for k, r in enumerate(rows) for line in r[1].split("\n")]
    gone = set()
    for s in range(len(seq)):
        best = 0
        for e in range(s):
            n = 0
            while s + n < len(seq) and seq[s + n][0] == seq[s][0] and seq[e + n][0] == seq[e][0] and seq[s + n][1] == seq[e + n][1]:
                n += 1
            best = max(best, n)
        if sum(len(line.split()) for _, line in seq[s : s + best]) >= 50:
            gone.update(range(s, s + best))
    left = defaultdict(list)
    for place, (k, line) in enumerate(seq):
        if place not in gone:
            left[k].append(line)
    return Counter((r[0], "\n".join(left[k])) for k, r in enumerate(rows) if left[k])


def test_stages_equal_brute_force(spark, stages):
    found, folder = stages(fixture())
    lettered = [r for r in found["in"] if re.search(r"[^\W\d_]", r[1] or "")]
    assert pairs(found["language"]) == pairs(lettered) and len(lettered) == 16

    ordered = sorted(found["language"], key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert pairs(found["line_dedup"]) == without_runs(ordered)
    assert len(found["line_dedup"]) == 15  # one document was nothing but a run

    rows = [r.asDict() for r in found["line_dedup"]]
    want = {(lowest, tuple(lowered(r["text"])) if lowest is None else None) for r, (_, _, lowest) in zip(rows, brute_components(rows))}
    assert len(found["near_duplicates"]) == len(want)
    assert {r.doc_id for r in found["near_duplicates"]} == {w[0] for w in want}
    assert not pairs(found["near_duplicates"]) - pairs(found["line_dedup"])

    taken = {r.doc_id: r.taken for r in mixing.mix_counts(spark.createDataFrame(found["near_duplicates"], SCHEMA)).collect()}
    words, text = Counter(), {r.doc_id: lowered(r.text) for r in found["near_duplicates"]}
    for r in found["mix"]:
        words[r.doc_id] += len(lowered(r.text))
        assert lowered(r.text) == text[r.doc_id][: len(lowered(r.text))]
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.default_model())
    coded = Counter((r.doc_id, model.decode(model.encode(r.text)), tuple(model.encode(r.text))) for r in found["mix"])
    assert Counter((r.doc_id, r.text, tuple(r.token_ids)) for r in found["tokens"]) == coded
    assert all(r.n_tokens == len(r.token_ids) for r in found["tokens"])

    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.text) for r in whole) == Counter((r.doc_id, r.text) for r in found["tokens"])


def test_empty_table(stages):
    found, _ = stages([])
    assert all(rows == [] for rows in found.values())


def test_columns_with_the_names_of_results(spark):
    """Columns that the last stage adds itself give way, in whatever case they are written."""
    rows = [(1, "some words", "en", "a", 10, 99, "x", 5), (2, None, "en", "a", 0, 99, "y", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, Token_IDs string, _row int")
    out = corpus_pipeline.encode(spark, docs, "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_row", "n_tokens", "token_ids"]
    got = {r.doc_id: (r.text, r.n_tokens, len(r.token_ids), r._row) for r in out.collect()}
    assert got[1][0] == "some words" and got[1][1] == got[1][2] > 0 and got[1][3] == 5
    assert got[2] == ("", 0, 0, 6)
