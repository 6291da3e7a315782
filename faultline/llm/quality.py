"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document; the ledger holds the measurements and
one bit per failed rule. A policy is a named, versioned set of rules, that is a
mask: a document is kept when it fails none of them, so a new policy reads the
ledger and no text. Ablations count the documents by their failure bits, which
are few values, and say for every rule how many documents it fails and how many
only it removes.

Windows of three words are compared by 64-bit hashes inside one document.

Defined results: a null text is an empty one, which fails ``few_words``; ties and
repeated rows are measured row by row, since no row depends on another; an empty
table gives an empty ledger. ``ledger`` adds a struct column and keeps the others.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import let
from faultline.llm.common import SPACE, text_of, words

SYMBOLS = "#*$%&|<>"
RULES = (  # name, failing condition over the measurements; a rule's bit is its place
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("exclamations", "100 * n_bangs > 30 * n_words"),
)
POLICIES = {  # versions stay as they are; a change is a new name
    "base_v1": ("few_words", "repeated_words"),
    "web_v1": tuple(name for name, _ in RULES),
}
BASE, PRODUCTION = "base_v1", "web_v1"


def repeated_words(tokens: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first time included."""

    def covered(places: Column) -> Column:
        steps = F.transform(
            places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def shared(ordered: Column) -> Column:
        def same(x: Column, neighbour: Column) -> Column:
            return F.coalesce(F.get(ordered, neighbour)["h"] == x["h"], F.lit(False))

        alike = F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return let(F.array_sort(F.transform(alike, lambda x: x["i"])), covered)

    def repeated(hashes: Column) -> Column:
        ordered = F.sort_array(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
            let(ordered, shared)
        )

    hashes = F.transform(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(tokens, i + 1), F.get(tokens, i + 2)),
    )
    return let(hashes, repeated)


def measured(text: Column) -> Column:
    """All measurements of a text in one struct of longs."""

    def count(pattern: str) -> Column:
        return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE[1:]}"))

    def all_of(tokens: Column) -> Column:
        values = {
            "n_words": F.size(tokens),
            "word_chars": F.length(F.array_join(tokens, "")),
            "n_symbols": count(f"[{SYMBOLS}]+"),
            "n_dup_lines": let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))),
            "n_repeat_words": repeated_words(tokens),
            "n_lines": F.size(lines),
            "n_bangs": count("!+"),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in values.items()])

    return let(words(text), all_of)


def bit(name: str) -> int:
    return 1 << [rule for rule, _ in RULES].index(name)


def mask(policy: str) -> int:
    return sum(bit(name) for name in POLICIES[policy])


def ledger(docs: DataFrame, column: str = "quality_ledger") -> DataFrame:
    """Adds a struct with the measurements and ``fail_bits``."""
    held = docs.select(F.struct("*").alias("_row"), measured(text_of()).alias("_m")).select(
        "_row", F.col("_m.*")
    )
    bits = sum(
        (F.when(F.expr(rule), bit(name)).otherwise(0) for name, rule in RULES), F.lit(0)
    ).cast("long")
    names = [c for c in held.columns if c != "_row"]
    return held.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != column],
        F.struct(*names, bits.alias("fail_bits")).alias(column),
    )


def passes(policy: str, bits: str = "quality_ledger.fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def apply_policy(ledgered: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    return ledgered.filter(passes(policy))


def ablations(ledgered: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """(policy, rule, fails, only): documents a rule fails, and those kept without just this rule."""
    failed = F.col("quality_ledger.fail_bits").bitwiseAND(F.lit(mask(policy)))
    counted = ledgered.groupBy(failed.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(
        *[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in POLICIES[policy]]
    )
    return (
        counted.select("bits", "n", F.inline(rules))
        .groupBy(F.lit(policy).alias("policy"), "rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) > 0, F.col("n")).otherwise(0)).alias("fails"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only"),
        )
    )


def verdicts(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    ledgered = ledger(docs.select("doc_id", "text"))
    return ledgered.select(
        "doc_id",
        "quality_ledger.*",
        (~passes(BASE)).alias("base_failed"),
        (passes(BASE) & passes(policy)).alias("kept"),
    )
