"""What the SQL cannot say about the registered corpus queries."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import pytest
import sentencepiece
from pyspark.sql import functions as F

from faultline.llm import licences, linededup, mixing, multiindex, ngramjoin, pii, quality, tokens
from faultline.llm import language, maxent, queries
from faultline.llm.common import documents

DIRECTORY = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

ODD = [
    (1, None, "en", "a", 0, "x", 1),
    (2, "", "en", None, 0, None, 2),
    (3, " \t\n ", None, "a", 4, "y", 3),
    (4, "one two", "en", "b", 7, "z", None),
    (4, "one two", "en", "b", 7, "z", None),
    (None, "one two", "en", "b", 7, "z", None),
    (5, "a b c d e f g " * 400, "en", "b", None, None, 5),
    (6, "42 17", "de", "c", 5, None, 6),
    (7, "é日本\U0001f600 mail me at x.y@mail.example.com or +1 (234) 555-1234", "fr", "c", 9, None, 7),
]


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """The tables are tiny; plans stay the same."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return [r.asDict() for r in documents(spark, DIRECTORY).collect()]


def lowered(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    words = lowered(text)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def brute_components(rows):
    sets, holders = [shingle_set(r["text"]) for r in rows], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, common in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * common >= 80 * (len(s) + len(sets[j]) - common):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    lowest = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            lowest[root(i)] = min(lowest.get(root(i), r["doc_id"]), r["doc_id"])
    return [
        (r["doc_id"], len(sets[i]), lowest.get(root(i)) if sets[i] else r["doc_id"]) for i, r in enumerate(rows)
    ]


def key(rows):
    return sorted(rows, key=lambda r: [(v is None, v if v is not None else 0) for v in r])


def test_ngram_join_equals_brute_force(spark, small):
    got = ngramjoin.join_report(documents(spark, DIRECTORY)).collect()
    assert key(map(tuple, got)) == key(brute_components(small))


def test_ngram_join_of_chains_and_large_groups(spark, monkeypatch):
    near, base = 60, 12
    monkeypatch.setattr(ngramjoin, "BLOCK", 8)
    text = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(near):
        words = list(text)
        for k in range(3 * (i % 7)):
            words[(i * 13 + k * 29) % 200] = f"e{i}x{k}"
        rows.append({"doc_id": 1000 + i, "text": " ".join(words)})
    for i in range(base):  # a chain: neighbours link, ends do not
        rows.append({"doc_id": i, "text": " ".join(f"c{k}" for k in range(5 * i, 5 * i + 120))})
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    got = ngramjoin.join_report(df.repartition(5)).collect()
    assert key(map(tuple, got)) == key(brute_components(rows))


def test_one_of_each_keeps_one_document_of_a_component(spark, odd):
    kept = ngramjoin.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 7] and None not in ids


def test_personal_data_equals_regular_expressions(spark, small, odd):
    def base(text):
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
            if all(int(p) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = re.sub("[^0-9]", "", m[0])
            check = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
            if 12 <= len(digits) <= 19 and check % 10 == 0:
                found.append((m.start(), 2, m.end()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
        return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))

    for df, rows in ((documents(spark, DIRECTORY), small), (odd, [dict(zip(odd.columns, r)) for r in ODD])):
        got = sorted(r.base_sha256 for r in pii.pii_report(df).collect())
        assert got == sorted(hashlib.sha256(base(r["text"] or "").encode()).hexdigest() for r in rows)


def test_redaction_names_the_kinds(odd):
    text = {r.doc_id: r.text for r in pii.redacted(odd).collect()}[7]
    assert text == "é日本\U0001f600 mail me at [email] or [phone]"


def test_tokens_equal_the_library(spark, small, odd):
    model = sentencepiece.SentencePieceProcessor(model_file=tokens.default_model())
    for df, rows in ((documents(spark, DIRECTORY), small), (odd, [dict(zip(odd.columns, r)) for r in ODD])):
        got = tokens.tokenized(df.select("doc_id", "text")).collect()
        want = {(r["text"] or ""): model.encode(r["text"] or "") for r in rows}
        assert len(got) == len(rows)
        for r in got:
            assert list(r.tokens.ids) == want[r.text or ""]
            assert r.tokens.decoded == model.decode(want[r.text or ""])


def test_language_on_held_out_documents(spark):
    df = documents(spark, "/root/testdata/sf0.01")
    got = language.language_report(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_without_letters_or_labels(spark, odd):
    got = {r.doc_id: r.lang_pred for r in language.language_report(odd).collect()}
    assert got[1] == got[2] == got[3] == got[6] == "und" and got[7] != "und"
    none = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.language_report(none).collect()} == {"und"}


@pytest.mark.parametrize("top", [400_000, 2_000])
def test_scores_equal_counts_and_sum_to_one(spark, small, top, monkeypatch):
    monkeypatch.setattr(maxent, "TOP", top)
    counts = Counter()
    for r in small:
        if zlib.crc32(str(r["doc_id"]).encode()) % 10:
            counts.update([*lowered(r["text"]), "\0end"])
    total, width = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    texts = {r["doc_id"]: [*lowered(r["text"]), "\0end"] for r in small}
    got = maxent.score_report(documents(spark, DIRECTORY)).collect()
    assert len(got) == len(small)
    for r in got:
        base = sum(log10((counts[w] + 0.1) / width) for w in texts[r.doc_id])
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.n_known == sum(counts[w] > 0 for w in texts[r.doc_id])
        assert (r.n_tokens, r.train_tokens) == (len(texts[r.doc_id]), total)
    trained = [r for r in got if not r.held_out]
    assert sum(r.score for r in trained) > sum(r.base_score for r in trained)


def test_rules_policies_and_ablations(spark, odd):
    held = quality.ledger(odd)
    assert held.columns == [*odd.columns, "quality_ledger"]
    failed = {r.doc_id: r.quality_ledger.fail_bits for r in held.collect()}
    assert failed[1] & quality.bit("few_words") and failed[5] & quality.bit("repeated_words")
    rows = {r.rule: (r.fails, r.only) for r in quality.ablations(held, quality.BASE).collect()}
    assert rows["few_words"][0] == 8 and rows["repeated_words"] == (1, 1)
    assert quality.apply_policy(held).count() == 0


def test_line_dedup_of_odd_rows(spark, odd):
    same = linededup.deduplicated(odd)
    assert same.columns == odd.columns and same.count() == len(ODD)
    run = "\n".join(f"line {k} with some more words in it" for k in range(8))
    rows = [(1, f"head\n\n{run}\n\ntail"), (2, f"other head\n{run}\n\nother tail"), (3, run), (3, run), (None, run)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.text for r in linededup.deduplicated(df).collect()), key=len)
    assert got == ["", "", "", "other head\nother tail", f"head\n\n{run}\n\ntail"]


def test_line_dedup_finds_whole_maximal_runs(spark):
    import random

    rng = random.Random(4)
    rows = []
    for i in range(120):
        lines = [" ".join(["w"] * rng.randint(0, 3)) + str(rng.randint(0, 3)) for _ in range(rng.randint(1, 30))]
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.deduplicated(df, min_words=6).collect()}
    seq = [(i, line) for i, text in rows for line in text.split("\n")]
    gone = set()
    for s in range(len(seq)):
        best = 0
        for e in range(s):
            n = 0
            while s + n < len(seq) and seq[s + n][0] == seq[s][0] and seq[e + n][0] == seq[e][0] and seq[s + n][1] == seq[e + n][1]:
                n += 1
            best = max(best, n)
        if sum(len(line.split()) for _, line in seq[s : s + best]) >= 6:
            gone.update(range(s, s + best))
    want = defaultdict(list)
    for k, (i, line) in enumerate(seq):
        if k not in gone:
            want[i].append(line)
    assert got == {i: "\n".join(want[i]) for i, _ in rows}


def test_mixing_meets_targets(spark, odd):
    for df in (documents(spark, "/root/testdata/sf0.01"), odd):
        rows = mixing.mix_counts(df).join(df.select("doc_id", "source").distinct(), "doc_id").collect()
        by_source = defaultdict(list)
        for r in rows:
            by_source[r.source].append(r)
            assert r.taken <= 3 * r.size
        for own in by_source.values():
            if None not in [r.doc_id for r in own]:
                assert abs(sum(r.taken for r in own) - own[0].target) <= 2 + len(own) * (own[0].size < 3)


def test_mixed_documents_hold_what_the_counts_say(spark):
    df = documents(spark, DIRECTORY)
    taken = {r.doc_id: r.taken for r in mixing.mix_counts(df).collect()}
    words = Counter()
    for r in mixing.mixed_documents(df).collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}


def test_search_of_ties_nulls_and_copies(spark):
    code = [[1.0 if (k * 7 + i) % 5 < 2 else -1.0 for k in range(64)] for i in range(6)]
    rows = [(i, code[i % 2]) for i in range(30)] + [(100 + i, code[i]) for i in range(6)] + [(200, None), (201, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in multiindex.search(df, df, k=5).collect():
        got[r.query_id].append((r.rank, r.neighbour_id, r.distance))
    valid = [(i, v) for i, v in rows if v is not None and len(v) == 64]
    for i, v in valid:
        near = sorted((sum((a > 0) != (b > 0) for a, b in zip(v, w)), j) for j, w in valid if j != i)[:5]
        assert sorted(got[i]) == [(n + 1, j, d) for n, (d, j) in enumerate(near)]
    assert 200 not in got and 201 not in got


def test_licences_of_altered_notices(spark, odd):
    notice = dict(licences.TEMPLATES[::-1])["MIT"]
    rows = [(1, "x y " * 50 + licences.TEMPLATES[4][1].replace("free", "without") + " z" * 30), (2, notice), (3, None), (4, "released under the mit")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.licence_report(df).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "", 4: ""}
    assert licences.scanned(odd).columns == [*odd.columns, "licences"]


EMPTY_SAFE = ["op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"]


@pytest.mark.parametrize("number", EMPTY_SAFE)
def test_empty_tables(spark, number, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    name = next(n for n in queries.QUERIES if n.split("_")[0] == number)
    assert queries.QUERIES[name](spark, folder).count() == 0


@pytest.mark.parametrize("number", EMPTY_SAFE)
def test_odd_rows(spark, number, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    name = next(n for n in queries.QUERIES if n.split("_")[0] == number)
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == len(ODD)


@pytest.mark.parametrize("rows", [0, 1, 3])
def test_search_in_tables_of_few_rows(spark, rows, monkeypatch):
    """Fewer rows than are asked for end the search as soon as all of them are met."""
    seen = []
    whole = multiindex.masks
    monkeypatch.setattr(multiindex, "masks", lambda width, radius: seen.append(radius) or whole(width, radius))
    vectors = [[1.0 if (k + i) % 3 else -1.0 for k in range(64)] for i in range(rows)]
    df = spark.createDataFrame([(100 * i, v, 1, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, code int, query string")
    got = multiindex.search(df, df, k=5).collect()
    assert len(got) == rows * max(0, rows - 1)
    assert max(seen) < 16


def test_probes_are_not_broadcast(spark, monkeypatch):
    """A few queries become many probes, which no size that Spark knows tells."""
    plans, checkpointed = [], multiindex.checkpointed

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return checkpointed(df)

    monkeypatch.setattr(multiindex, "checkpointed", seen)
    vectors = [(i, [float((i * 7 + d * 3) % 5 - 2) for d in range(64)]) for i in range(40)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    multiindex.search(df, df, k=3)
    probed = [line for plan in plans for line in plan.splitlines() if "Join" in line and "seg#" in line]
    assert probed and all("strategy=merge" in line for line in probed)
