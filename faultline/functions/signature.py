"""Log fingerprint as one column expression.

A log stays one row: its tail becomes an array of lines, and detection, text,
hint and excerpt are array expressions over it. There is no shuffle, so the
same expression serves batch and streaming. The costly rewrites touch only
pre-screened lines (at most 200) and the window around the chosen line.
"""

from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.functions import patterns as P
from faultline.functions.reuse import once_per_context
from faultline.functions.text import SPACE_CLASS, clip, col, filled, let, trim

FALLBACK_NEAR = 60  # at least the lines a fallback hint looks at
HINT_CATEGORIES = ["test_failure", "compile_error", "lint_error"]


def spaced(pattern: str) -> str:
    """The pattern with ``\\s`` and ``\\S`` read as all white space, not as ASCII only."""
    inside, out, at = False, [], 0
    wide = SPACE_CLASS[1:-1]
    while at < len(pattern):
        piece = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        if piece == r"\s":
            out.append(wide if inside else f"[{wide}]")
        elif piece == r"\S":
            out.append(f"[^{wide}]")
        else:
            out.append(piece)
            inside = piece == "[" or (inside and piece != "]")
        at += len(piece)
    return "".join(out)


def any_of(alternatives) -> str:
    return spaced("|".join(f"(?:{p})" for p in alternatives))


def tail_lines(log, lines: int = S.TAIL_LINES, chars: int = S.TAIL_CHARS) -> Column:
    """The last lines of a log: cut after the newline before the last ``lines`` breaks."""
    parts = F.split(F.right(F.coalesce(col(log), F.lit("")), F.lit(chars)), "\n")
    return let(parts, lambda p: last(p, lines + 1))


def last(array, n: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - (n - 1), F.lit(1)), F.lit(n))


def first(array) -> Column:
    return F.get(array, F.lit(0))


def rewritten(text, rewrites) -> Column:
    return reduce(lambda s, rw: F.regexp_replace(s, spaced(rw[0]), rw[1]), rewrites, text)


def normalise(line) -> Column:
    """One line without anything that changes between two runs of one failure.

    A rewrite is tried only on lines that hold a text its pattern cannot do without.
    """
    shaped = rewritten_in_steps(col(line), range(P.FIRST_SCALAR))
    scalars = range(P.FIRST_SCALAR, P.AFTER_SCALARS)
    counted = let(
        shaped, lambda x: F.when(has_any(x, P.DIGITS), rewritten_in_steps(x, scalars)).otherwise(x)
    )
    return trim(rewritten_in_steps(counted, range(P.AFTER_SCALARS, len(P.REWRITES))))


def rewritten_in_steps(text, numbers: range) -> Column:
    """Rewrites one after the other as a fold: the text so far is a variable, so each looks at it first."""

    def step(x, number):
        pattern, replacement = P.REWRITES[number]
        done = F.regexp_replace(x, spaced(pattern), replacement)
        return F.when(has_any(x, P.REWRITE_NEEDS[number]), done).otherwise(x)

    def chosen(x, i, some: range):
        if len(some) == 1:
            return step(x, some[0])
        middle = len(some) // 2
        return F.when(i < some[middle], chosen(x, i, some[:middle])).otherwise(chosen(x, i, some[middle:]))

    return F.aggregate(F.array(*[F.lit(n) for n in numbers]), text, lambda x, i: chosen(x, i, numbers))


def has_any(text, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def present_words(lines) -> Column:
    """The trigger words that a log holds at all: few, so its lines are tested for these alone."""
    words = F.array(*[F.lit(w) for w in P.TRIGGER_WORDS])
    return let(F.lower(F.array_join(lines, "\n")), lambda low: F.filter(words, lambda w: low.contains(w)))


def is_candidate(line, words) -> Column:
    """Pre-screen of a raw line: plain substring tests, many times cheaper than one pattern."""
    text = col(line)
    size = F.length(text)
    worded = let(F.lower(text), lambda low: F.exists(words, lambda w: low.contains(w)))
    return (size > 0) & (size < S.CANDIDATE_LINE_CHARS) & worded


def candidate_positions(lines) -> Column:
    """Positions (from 0) of the newest pre-screened lines, in log order."""

    def found(words):
        return F.filter(
            F.transform(lines, lambda x, i: F.when(is_candidate(x, words), i)), lambda i: i.isNotNull()
        )

    return let(let(present_words(lines), found), lambda f: last(f, S.CANDIDATE_LINES))


def holds(text, low, needed: str) -> Column:
    start, word = needed[0] == "^" and len(needed) > 1, needed.removeprefix("^")
    where = text if word != word.lower() else low
    return where.startswith(word) if start else where.contains(word)


def fires(text, low, number: int) -> Column:
    """Whether a rule group fires: each pattern is tried only where its texts are."""
    tests = [
        reduce(lambda a, b: a | b, [holds(text, low, n) for n in needed]) & text.rlike(spaced(pattern))
        for pattern, needed in zip(P.RULES[number][3], P.NEEDED[number], strict=True)
    ]
    return reduce(lambda a, b: a | b, tests)


def rule_of(text, low, numbers) -> Column:
    """Number of the first of some rule groups that fires on a normalised line, else null."""
    branch = None
    for number in numbers:
        test = fires(text, low, number)
        branch = F.when(test, number) if branch is None else branch.when(test, number)
    return branch


def rule_value(number, field: int) -> Column:
    return F.get(F.array(*[F.lit(rule[field]) for rule in P.RULES]), number)


def stages() -> list[list[int]]:
    """The rule groups by category, in order of priority; no category comes twice."""
    numbers = range(len(P.RULES))
    return [list(group) for _, group in groupby(numbers, key=lambda n: P.RULES[n][0])]


def detect(lines) -> Column:
    """struct(priority, newest, rule) of the winning line, or null when no rule fires.

    The rules go stage by stage over all candidates, the lowest priorities first; a stage
    in which a rule fires is the last one.
    """

    def winner(candidates, numbers):
        def hit(c):
            return let(
                rule_of(c["text"], c["low"], numbers),
                lambda g: F.when(
                    g.isNotNull(),
                    F.struct(rule_value(g, 1).alias("priority"), (-c["i"]).alias("newest"), g.alias("rule")),
                ),
            )

        return F.array_min(F.transform(candidates, hit))

    def prepared(i):
        return let(
            normalise(F.get(lines, i)),
            lambda n: F.struct(i.alias("i"), n.alias("text"), F.lower(n).alias("low")),
        )

    return let(
        F.transform(candidate_positions(lines), prepared),
        lambda candidates: F.coalesce(*[winner(candidates, numbers) for numbers in stages()]),
    )


def is_noise(line) -> Column:
    text = col(line)
    noisy = F.substring(text, 1, 1).isin(P.NOISE_STARTS) & text.rlike(any_of(P.NOISE))
    return (F.length(text) < 3) | noisy


def clip_line(line) -> Column:
    return clip(line, S.SIGNATURE_LINE_CHARS)


def informative(normalised) -> Column:
    """Clipped lines with blanks and noise removed, in order."""
    kept = F.filter(normalised, lambda n: (n != "") & ~is_noise(n))
    return F.transform(kept, clip_line)


def window(lines, start, end) -> Column:
    """lines[start, end) with both ends clamped to the log."""
    low = F.greatest(start, F.lit(0))
    high = F.least(end, F.size(lines))
    return F.slice(lines, low + 1, F.greatest(high - low, F.lit(0)))


def excerpt(lines, position) -> Column:
    """Raw text around a line."""
    part = window(lines, position - S.EXCERPT_BEFORE, position + S.EXCERPT_AFTER)
    return F.substring(F.array_join(part, "\n"), 1, S.EXCERPT_CHARS)


def signature_text(forward) -> Column:
    """The matched line and the next informative ones; ``forward`` is normalised."""
    head = F.filter(F.slice(forward, 1, 1), lambda n: n != "")
    rest = F.filter(
        F.slice(forward, 2, S.SIGNATURE_LOOKAHEAD - 1), lambda n: (n != "") & ~is_noise(n)
    )
    distinct = F.array_distinct(F.transform(F.concat(head, rest), clip_line))
    return F.array_join(F.slice(distinct, 1, S.SIGNATURE_LINES), "\n")


def extracted(lines, pattern: str, *must_contain: str) -> Column:
    found = F.transform(
        F.filter(lines, lambda x: has_any(x, must_contain)),
        lambda x: F.regexp_extract(x, spaced(pattern), 1),
    )
    return F.filter(found, lambda x: x != "")


def file_hint(lines) -> Column:
    """Best-guess file for a window of normalised lines."""
    files = F.filter(
        extracted(lines, P.SOURCE_FILE, *P.SOURCE_NEEDS), lambda f: ~f.contains("node_modules/")
    )
    return let(
        files,
        lambda fs: F.coalesce(
            first(extracted(lines, P.PYTEST_NODE, ".py::")),
            first(F.filter(fs, lambda f: f.rlike(spaced(P.TEST_FILE)))),
            first(extracted(lines, P.JAVA_CLASS, "(")),
            first(fs),
            first(F.transform(extracted(lines, P.BULLET_TITLE, "●"), trim)),
        ),
    )


def signature_hash(category, text) -> Column:
    payload = F.concat(col(category), F.lit("\n"), col(text))
    return F.substring(F.sha2(payload, 256), 1, S.HASH_CHARS)


def _fields(text, category, hint, extract, confidence) -> Column:
    return let(
        text,
        lambda t: F.struct(
            signature_hash(category, t).alias("hash"),
            t.alias("text"),
            category.alias("category"),
            hint.alias("file_hint"),
            extract.alias("excerpt"),
            confidence.alias("confidence"),
        ),
    )


def matched_signature(lines, hit) -> Column:
    at = -hit["newest"]
    category = rule_value(hit["rule"], 0)
    forward = F.transform(window(lines, at, at + S.EXCERPT_AFTER), normalise)
    before = F.when(
        category.isin(HINT_CATEGORIES),
        let(
            F.transform(window(lines, at - S.HINT_BEFORE, at), normalise),
            file_hint,
        ),
    )
    return let(
        forward,
        lambda fw: _fields(
            signature_text(fw),
            category,
            F.coalesce(file_hint(fw), before),
            excerpt(lines, at),
            rule_value(hit["rule"], 2),
        ),
    )


def fallback_text(lines, near) -> Column:
    """The last informative lines. ``near``, the normalised end of the log, is tried first."""
    kept = let(
        informative(near),
        lambda tail: F.when(
            (F.size(tail) >= S.SIGNATURE_LINES) | (F.size(lines) <= FALLBACK_NEAR), tail
        ).otherwise(informative(F.transform(lines, normalise))),
    )
    text = let(kept, lambda k: F.array_join(last(k, S.SIGNATURE_LINES), "\n"))
    return F.coalesce(let(text, lambda t: F.when(t != "", t)), F.lit("unclassified failure"))


def fallback_signature(lines) -> Column:
    at = F.greatest(F.size(lines) - S.EXCERPT_AFTER, F.lit(0))
    return let(
        F.transform(last(lines, FALLBACK_NEAR), normalise),
        lambda near: _fields(
            fallback_text(lines, near),
            F.lit("unknown"),
            let(last(near, S.FALLBACK_HINT_LINES), file_hint),
            excerpt(lines, at),
            F.lit(0.2),
        ),
    )


def is_blank(lines) -> Column:
    return F.forall(lines, lambda x: filled(x).isNull())


@once_per_context
def fingerprint(log: str) -> Column:
    """struct(hash, text, category, file_hint, excerpt, confidence) of a raw log."""
    empty = _fields(
        F.lit("empty log"), F.lit("unknown"), F.lit(None).cast("string"), F.lit(""), F.lit(0.0)
    )
    return let(
        tail_lines(log),
        lambda lines: F.when(is_blank(lines), empty).otherwise(
            let(
                detect(lines),
                lambda hit: F.when(hit.isNotNull(), matched_signature(lines, hit)).otherwise(
                    fallback_signature(lines)
                ),
            )
        ),
    )
