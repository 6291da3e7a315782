import re

import pytest
from pyspark.sql import functions as F

from faultline.functions import signature as sig
from faultline.operators import fingerprint as fp

ESC = chr(27)


def prints(spark, logs):
    rows = list(enumerate(logs))
    df = spark.createDataFrame(rows, "log_id long, log_text string")
    found = {r.log_id: r for r in fp.fingerprint_logs(df).collect()}
    return [found[i] for i in range(len(logs))]


# fixed values: lines and what they are normalised to
NORMALISED = {
    "2026-02-17T11:04:26.1131138Z       at Obj.<anon> (/home/runner/work/acme/acme/src/shop/cart.test.ts:44:34)":
        "at Obj.<anon> (shop/cart.test.ts:<L>:<C>)",
    "[2026-02-17T09:12:52.774Z] [ERROR] /var/lib/ci/workspace/x/src/main/java/com/acme/Bill.java:[142,38] cannot find symbol":
        "[ERROR] acme/Bill.java:[<L>,<C>] cannot find symbol",
    "[INFO] Total time:  11.204 s": "[INFO] Total time: <DUR>",
    f"{ESC}[31mFAIL{ESC}[0m src/a.test.ts": "FAIL src/a.test.ts",
    "Heap dump written at 0x7f9c48001000 by pid 4211": "Heap dump written at <ADDR> by pid <PID>",
    "run 3f7a91c0-2b44-4c1e-9a0d-8e5f61b2c703 build #1284": "run <UUID> build #<N>",
    "##[error]Process completed with exit code 1.": "[ERROR] Process completed with exit code 1.",
    "##[group]Run tests": "Run tests",
    r"C:\agent\work\src\app.cs(12,5): error": "src/app.cs(<L>,<C>): error",
    r"C:\a": r"C:\a",
    r"C:\a\b": "a/b",
    "see /etc/hosts and /usr/lib": "see /etc/hosts and /usr/lib",
    "commit deadbeef1 defaced": "commit <HEX> defaced",
    "build 12345678 took 12 minutes": "build <N> took <DUR>",
    "got 12.5 MB from 10.0.0.1:5432": "got <SIZE> from 10.0.0.1:<PORT>",
    "[ERROR] src/main/java/A.java:[10] Unused [Checkstyle]": "[ERROR] src/main/java/A.java:[10] Unused [Checkstyle]",
}


def test_normalised_lines(spark):
    df = spark.createDataFrame([(k,) for k in NORMALISED], "line string")
    got = {r.line: r.n for r in df.select("line", sig.normalise("line").alias("n")).collect()}
    assert got == NORMALISED


def test_normalise_is_idempotent(spark):
    df = spark.createDataFrame([(k,) for k in NORMALISED if "\\" not in k], "line string")
    once = df.select(sig.normalise("line").alias("a")).select("a", sig.normalise("a").alias("b"))
    assert all(r.a == r.b for r in once.collect())


# fixed values: logs and what they are classified as
CASES = [
    ("test_failure", "E   AssertionError: assert 3 == 4\ntests/test_bill.py:88: AssertionError\n=== 1 failed, 12 passed in 3.21s ==="),
    ("test_failure", "[ERROR] Tests run: 14, Failures: 1, Errors: 0, Skipped: 0 <<< FAILURE! - in com.acme.BillTest"),
    ("compile_error", "src/app/main.ts(42,17): error TS2345: Argument of type 'a' is not assignable.\nFound 1 error."),
    ("compile_error", "/ws/src/Foo.java:88: error: cannot find symbol\n    calc.tax(x);\n        ^"),
    ("dependency_error", "npm ERR! code ERESOLVE\nnpm ERR! ERESOLVE unable to resolve dependency tree"),
    ("dependency_error", "ERROR: No matching distribution found for pandas==9.9.9"),
    ("dependency_error", "[ERROR] Failed to execute goal on project svc: Could not resolve dependencies for project a:b:1"),
    ("oom", "The process was terminated.\n##[error]Process completed with exit code 137."),
    ("oom", "Running\n/usr/bin/bash: line 5: 4211 Killed                  node ./build.js"),
    ("oom", "Exception in thread main java.lang.OutOfMemoryError: Java heap space"),
    ("infra_timeout", "##[error]The operation was canceled.\nError: The runner has received a shutdown signal."),
    ("infra_timeout", "timeout: sending signal TERM to command 'npm'\nmake: *** [test] Error 124"),
    ("lint_error", "/ws/src/a.ts\n  12:5   error  Unexpected console  no-console\n\n✖ 2 problems (2 errors, 0 warnings)"),
    ("lint_error", "[ERROR] src/main/java/A.java:[10] (imports) Unused import. [Checkstyle]"),
    ("permission_error", "remote: Permission to acme/app.git denied to bot.\nfatal: unable to access: error: 403"),
    ("permission_error", "npm ERR! code EACCES\nnpm ERR! Error: EACCES: permission denied"),
    ("network_error", "Error: connect ECONNREFUSED 127.0.0.1:5432\n    at TCPConnectWrap.afterConnect"),
    ("network_error", "curl: (6) Could not resolve host: registry.test\ngetaddrinfo EAI_AGAIN registry.test"),
    ("oom", "FAIL src/big.test.ts\n  ● big › explodes\nFATAL ERROR: Reached heap limit - JavaScript heap out of memory"),
    ("test_failure", "FAIL src/cart.test.ts\n  ● cart › totals\nnpm ERR! Lifecycle script `test` failed with error:\nnpm ERR! code 1"),
]


def test_categories(spark):
    for (expected, log), got in zip(CASES, prints(spark, [log for _, log in CASES])):
        assert got.category == expected, log
        assert got.confidence >= 0.75, log
        assert re.fullmatch("[0-9a-f]{32}", got.hash)
        assert 1 <= len(got.text.split("\n")) <= 5


def rerun(log):
    """The same failure on a later run: other clock, folders, ids and durations."""
    log = re.sub(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d+Z", "2027-11-30T22:41:09.555Z", log)
    log = log.replace("/home/runner/work/app/app", "/data/agent-11/ws/job/checkout")
    log = re.sub(r"\d+\.\d+ s\b", "41.007 s", log)
    return log.replace(":5432", ":6379").replace("#1284", "#9")


def test_hash_survives_a_rerun(spark):
    base = "\n".join(
        f"2026-02-17T11:04:26.113Z {line}"
        for line in [
            "Run npm test #1284", "FAIL /home/runner/work/app/app/src/cart.test.ts", "  ● cart › totals",
            "    at Obj (/home/runner/work/app/app/src/cart.test.ts:12:4)", "connect ECONNREFUSED 10.0.0.4:5432",
            "Time: 3.5 s",
        ]
    )
    bare = "\n".join(line.split("Z ", 1)[1] for line in base.split("\n"))
    other = base.replace("totals", "discounts")
    a, b, c, d = prints(spark, [base, rerun(base), bare, other])
    assert rerun(base) != base
    assert a.hash == b.hash == c.hash != d.hash
    assert a.file_hint.endswith("cart.test.ts")


def test_hosts_count_and_ports_do_not(spark):
    a, b, c = prints(
        spark,
        ["Error: connect ECONNREFUSED 10.0.0.4:5432", "Error: connect ECONNREFUSED 10.0.0.4:6379",
         "Error: getaddrinfo ENOTFOUND registry.test"],
    )
    assert a.hash == b.hash != c.hash


def test_empty_and_plain_logs(spark):
    got = prints(spark, ["", "\n\n\n", "   \n\t\n", None, "hello world\nnothing here\njust output\n", "--\n=="])
    assert [g.text for g in got[:4]] == ["empty log"] * 4
    assert [g.confidence for g in got[:4]] == [0.0] * 4
    assert got[4].category == "unknown" and got[4].confidence == 0.2
    assert got[4].text == "hello world\nnothing here\njust output"
    assert got[5].text == "unclassified failure"


def test_hostile_logs(spark):
    logs = [
        "a" * 200_000, f"{ESC}[2K{ESC}[31m mangled {ESC}[0m", "(" * 5000,
        "/very/deep/path" * 400 + " error TS2345: nope",
        "\n".join(["error: " * 60] * 500), "/" * 20_000, "error " + "a/" * 1500,
    ]
    for got in prints(spark, logs):
        assert re.fullmatch("[0-9a-f]{32}", got.hash)
        assert len(got.excerpt) <= 4000


def test_tail(spark):
    filler = [f"step {i} ............" for i in range(4000)]
    log = "\n".join(["FATAL ERROR: JavaScript heap out of memory", *filler, "LAST"])
    df = spark.createDataFrame([(1, log), (2, "single line"), (3, "x" * 600_000)], "log_id long, log_text string")
    tail = {r.log_id: r.lines for r in fp.log_tail(df).collect()}
    assert len(tail[1]) == 2001 and tail[1][-1] == "LAST"
    assert tail[2] == ["single line"]
    assert len(tail[3][0]) == 512_000
    assert prints(spark, [log])[0].category == "unknown"


def test_newest_candidates_only(spark):
    """Only the newest 200 pre-screened lines are classified."""
    many = ["java.lang.OutOfMemoryError"] + ["error nothing known"] * 250
    few = ["java.lang.OutOfMemoryError"] + ["error nothing known"] * 100
    assert [g.category for g in prints(spark, ["\n".join(many), "\n".join(few)])] == ["unknown", "oom"]


def test_fallback_looks_past_a_noisy_end(spark):
    log = "\n".join([f"useful {i} line" for i in range(9)] + ["-----"] * 300)
    got = prints(spark, [log])[0]
    assert got.text == "\n".join(f"useful {i} line" for i in range(4, 9))


@pytest.mark.parametrize("n", [1, 7])
def test_signature_text_is_distinct_and_bounded(spark, n):
    log = "\n".join(["FAIL src/a.test.ts"] + ["same line here"] * n + [f"other line {c}" for c in "abcdefg"])
    text = prints(spark, [log])[0].text.split("\n")
    assert text == ["FAIL src/a.test.ts", "same line here", "other line a", "other line b", "other line c"]


def samples(pattern):
    """Texts that match a rule's alternatives, built by hand-free expansion of the simple ones."""
    text = re.sub(r"\(\?i:(.*)\)$", r"\1", pattern).replace("(?!Console)", "").replace(r"(?!0\b)", "")
    text = text.lstrip("^").rstrip("$").replace(r"\b", "")
    for a, b in [(r"\d{1,6}", "3"), (r"\d{4,5}", "2345"), (r"\d{3,4}", "123"), (r"\d{2,3}", "12"), (r"\d{1,3}", "7"),
                 (r"\s{0,4}", " "), (r"\s+", " "), (r"\S{1,200}", "abc"), (r"\S{1,120}", "abc"), (r"\S{1,80}", "abc"),
                 (r"\S{0,120}", "abc"), (r"\S{0,80}", "abc"), (r"\w{0,80}", ""), (r"\w{0,40}", ""), (r"\w{1,10}", "TERM"),
                 (r"[\w.-]{1,64}", "host"), (r".{0,80}", " "), (r".{0,60}", " "), (r".{0,40}", " "), (r"\S", "x"),
                 (r"[: ]{1,3}", " "), ("[Cc]", "C"), ("[EWF]", "E"), ("40[13]", "401"), ("=+", "==="), (r"kts?", "kt"),
                 ("Tests?", "Tests"), ("Suites?", "Suites"), ("problems?", "problem")]:
        text = text.replace(a, b)
    text = text.replace(r"\(", "\x01").replace(r"\)", "\x02")
    out = [text]
    while any("(?:" in t or re.search(r"\[[✕✖✗×]+\]", t) for t in out):
        t = next(t for t in out if "(?:" in t or re.search(r"\[[✕✖✗×]+\]", t))
        out.remove(t)
        m = re.search(r"\(\?:([^()]*)\)(\?)?", t) or re.search(r"\[([✕✖✗×]+)\]()", t)
        options = m.group(1).split("|") if m.group(0).startswith("(") else list(m.group(1))
        out += [t[: m.start()] + o + t[m.end():] for o in options + ([""] if m.group(2) else [])]
    flat = [p for t in out for p in t.split("|")]
    return [re.sub(r"\\(.)", r"\1", t).replace("\x01", "(").replace("\x02", ")") for t in flat]


def all_lines():
    """Lines for every pattern, in other cases, behind markers, and lines of test data and noise."""
    from faultline.functions import patterns as P

    lines = {t for rule in P.RULES for p in rule[3] for t in samples(p)}
    lines |= {t.swapcase() for t in lines} | {"[ERROR] " + t for t in lines}
    lines |= {
        "\x1b[31m2024-02-03T04:05:06.123Z ##[error]\r at /a/b/c/d.ts:12:3 took 12 ms", "2024-02-03 [12:00:01] x  y\tz",
        "##\x1b[0m[error] 1", "##\r[group]x", "C:\\a\\b\\c.kt (3,14): pid = 4711 #12 0XFF 12 KB 3 bytes", "<TS> <TS> <TS> <TS> <TS> x",
        "deadbeef1 abcdefab 123e4567-e89b-12d3-a456-426614174000 localhost:8080 LiNe 12", "[ <TS> ] ##[debug] <TS>x",
        "-----", "== ==", "[INFO] ----", "> 12 | x", "|   ^^^", "Downloading x", "Progress", "Requirement already satisfied", "12 |",
        "a.swift", "b.vue:3", "x.cpp", "y.hpp", "z.mjs", "src/a.test.tsx", "no file", "at a.b.CTest.run(CTest.java:3)", "",
    }
    return sorted(lines)


def test_needed_texts_never_hide_a_rule(spark):
    """Whatever a pattern matches also holds one of its needed texts."""
    from faultline.functions import patterns as P

    df = spark.createDataFrame([(t,) for t in all_lines()], "line string")
    for rule, needed in zip(P.RULES, P.NEEDED, strict=True):
        columns = {f"p{j}": F.col("line").rlike(sig.spaced(p)) for j, p in enumerate(rule[3])}
        rows = df.select("line", *[c.alias(n) for n, c in columns.items()]).collect()
        for j, texts in enumerate(needed):
            matched = [r.line for r in rows if r[f"p{j}"]]
            assert matched, f"no sample for {rule[3][j]}"
            for line in matched:
                found = []
                for text in texts:
                    word = text.removeprefix("^") if len(text) > 1 else text
                    where = line if word != word.lower() else line.lower()
                    found.append(where.startswith(word) if word != text else word in where)
                assert any(found), (rule[3][j], line)


def test_guards_change_no_line(spark):
    """Rewrites, noise and file names with and without the texts they need."""
    from faultline.functions import patterns as P
    from faultline.functions.text import trim

    df = spark.createDataFrame([(t,) for t in all_lines()], "line string").withColumn("plain", trim(sig.rewritten(F.col("line"), P.REWRITES)))
    assert len(P.REWRITE_NEEDS) == len(P.REWRITES)
    noisy = (F.length("plain") < 3) | F.col("plain").rlike(sig.any_of(P.NOISE))
    hint = F.regexp_extract("plain", sig.spaced(P.SOURCE_FILE), 1)
    rows = df.select(
        "line", "plain", sig.normalise("line").alias("guarded"), noisy.alias("noise"), sig.is_noise("plain").alias("guarded_noise"),
        hint.alias("file"), F.coalesce(F.get(sig.extracted(F.array("plain"), P.SOURCE_FILE, *P.SOURCE_NEEDS), F.lit(0)), F.lit("")).alias("guarded_file"),
    ).collect()
    for r in rows:
        assert (r.guarded, r.guarded_noise, r.guarded_file) == (r.plain, r.noise, r.file), r.line
    assert sum(r.line != r.plain for r in rows) > 20 and sum(r.noise for r in rows) > 5 and sum(r.file != "" for r in rows) > 5


def test_stages_find_the_lowest_priority(spark):
    """One line of every rule in all pairs: the winner is that of one pass over all rules."""
    from faultline.functions import patterns as P

    numbers = [n for stage in sig.stages() for n in stage]
    assert numbers == list(range(len(P.RULES))) and len(sig.stages()) < len(P.RULES)
    firsts = [samples(rule[3][0])[0] for rule in P.RULES]
    logs = [f"{a}\n{b}" for a in firsts for b in firsts[::5]]
    df = spark.createDataFrame([(i, log) for i, log in enumerate(logs)], "log_id long, log_text string")
    got = {r.log_id: (r.priority, r.line_index) for r in fp.classify_logs(df).collect()}
    lines = df.select("log_id", F.posexplode(F.split("log_text", "\n")).alias("i", "raw")).withColumn("line", sig.normalise("raw"))
    rule = F.coalesce(*[F.when(F.col("line").rlike(sig.any_of(r[3])), n) for n, r in enumerate(P.RULES)])
    want = {}
    for r in lines.filter(F.lower("raw").rlike("|".join(re.escape(w) for w in P.TRIGGER_WORDS))).withColumn("rule", rule).collect():
        if r.rule is not None:
            key = (P.RULES[r.rule][1], -r.i)
            want[r.log_id] = min(want.get(r.log_id, key), key)
    assert got == {k: (p, -i) for k, (p, i) in want.items()}


@pytest.mark.parametrize("space", ["﻿", " ", " ", "　"])
def test_every_white_space_counts(spark, space):
    logs = [
        f"{space}2024-02-03T04:05:06.1Z ##[error]Process completed with exit code 3.",
        "2024-02-03T04:05:06.1Z ##[error]Process completed with exit code 3.",
        f"●{space}cart › totals fails\nTests: 1 failed",
        "● cart › totals fails\nTests: 1 failed",
        f"FAIL{space}src/cart.test.ts",
        "FAIL src/cart.test.ts",
    ]
    found = prints(spark, logs)
    for odd, plain in zip(found[::2], found[1::2]):
        assert (odd.category, odd.confidence) == (plain.category, plain.confidence)
    assert found[0].hash == found[1].hash


def test_normalising_is_not_repeated_by_the_noise_filter(spark):
    lines = spark.createDataFrame([(1, 0, "12:00:01 done in 4 s"), (1, 1, "----"), (1, 2, None)], "log_id long, i int, line string")
    kept = fp.drop_noise_lines(fp.normalise_lines(lines))

    def folds(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")

    assert 0 < folds(kept) == folds(fp.normalise_lines(lines))
    assert [r.normalised for r in kept.collect()] == ["done in <DUR>"]
    assert [r.normalised for r in fp.normalise_lines(lines).collect()] == ["done in <DUR>", "----", None]


@pytest.mark.parametrize("files", [1, 30])
def test_no_task_gets_more_rows_however_few_splits_hold_them(spark, scratch, monkeypatch, files):
    from faultline.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    spark.range(20_000).repartition(files).write.parquet(f"{scratch}/t")
    dealt = tables.spread(spark.read.parquet(f"{scratch}/t"), "id")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 700
    assert tables.spread(dealt, "id").rdd.getNumPartitions() >= 40
    monkeypatch.setattr(tables, "TASK_ROWS", 700)
    assert tables.spread(dealt, "id") is dealt
