"""Mixing sources to target weights by capped water-filling.

Every source gets a share of all words in proportion to its weight, clamped at
``cap`` times its own words; the excess of clamped sources goes to the others by
weight until no source is above its cap. The repetitions of a source are its
target over its size: the whole part repeats every document, the fraction is met
by the documents that come first in a seeded order, and the document at the cut
gives as many words as are still missing.

The order is the md5 of seed and id, so a decision depends on the row and on one
line per source only. The cut of a source is searched through prefixes of the
md5: every step sums at most 4096 ranges per source, after partial sums, and
looks into one of them next. A source that holds most rows is never gathered.

Defined results: a null text has no words and is taken zero words; a null source
is a source of its own, ordered last; a null id is hashed as empty text; rows
with the same id are taken alike, and at the cut they share what is missing in
proportion to their size; an empty table gives an empty result. Columns beside
``doc_id``, ``text``, ``source`` and ``n_chars`` pass through.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.ordering import with_row_numbers
from faultline.llm.common import id_text, small_side, text_of, word_count, words
from faultline.sources.checkpoints import checkpointed

WEIGHTS = (1, 2, 3)  # repeat over the sources in code point order
CAP = 3  # epochs of a source at most
SEED = 7
PREFIXES = (3, 6, 9, 12, 32)  # hex digits of the md5 that the search fixes step by step


def source_key() -> Column:
    """Sorts as the source does by code point, with null last; never null."""
    return F.when(F.col("source").isNull(), "z").otherwise(F.concat(F.lit("s"), F.col("source")))


def seeded_order(seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), id_text()))


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    return docs.select(
        "doc_id",
        source_key().alias("_src"),
        seeded_order(seed).alias("_order"),
        word_count(text_of()).alias("size"),
    )


def water_level(sources: DataFrame, cap: int) -> tuple[int, int]:
    """Words and weight of the sources below their cap once no target is above its cap.

    ``sources`` has one row per source (source_size, weight). A round clamps every
    source whose share is above its cap; the level only rises, so the clamped set
    only grows and the loop ends when a round clamps nothing new.
    """
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weight = total or 0, weight or 1
    rest, open_weight = total, weight
    while True:
        clamped = sources.filter(above_cap(rest, open_weight, cap)).agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))
        )
        size, taken = clamped.first()
        found = (total - cap * size, max(1, weight - taken))
        if found == (rest, open_weight):
            return found
        rest, open_weight = found


def share(rest: int, open_weight: int) -> Column:
    return F.lit(float(rest)) * F.col("weight").cast("double") / F.lit(float(open_weight))


def above_cap(rest: int, open_weight: int, cap: int) -> Column:
    return share(rest, open_weight) > (F.col("source_size") * cap).cast("double")


def source_plan(narrow: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: size, target, whole repetitions, the cut and what is missing there."""
    totals = narrow.groupBy("_src").agg(F.sum("size").alias("source_size"))
    ranked = with_row_numbers(totals, ["_src"], "_rank")
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")
    )
    sources = checkpointed(ranked.select("_src", "source_size", weight.cast("long").alias("weight")))
    rest, open_weight = water_level(sources, cap)
    target = F.when(
        above_cap(rest, open_weight, cap), (F.col("source_size") * cap).cast("double")
    ).otherwise(share(rest, open_weight))
    whole = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(0)
    planned = sources.withColumn("target", target).withColumn("whole", whole.cast("long"))
    extra = F.floor(F.col("target")) - F.col("whole") * F.col("source_size")
    planned = checkpointed(planned.withColumn("_need", F.greatest(extra, F.lit(0)).cast("long")))
    cuts = find_cuts(narrow, planned.filter("_need > 0").select("_src", "_need"))
    return checkpointed(
        planned.drop("_need", "weight")
        .join(cuts, "_src", "left")
        .fillna({"_cut": "", "_missing": 0, "_at_cut": 1})
    )


def find_cuts(narrow: DataFrame, needs: DataFrame) -> DataFrame:
    """The place in the seeded order where the running size of a source passes its need."""
    state = needs.withColumn("_cut", F.lit(""))
    before = Window.partitionBy("_src").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
    known = 0
    for digits in PREFIXES:
        inside = narrow.withColumn("_cut", F.substring("_order", 1, known)).join(
            small_side(checkpointed(state)), ["_src", "_cut"]
        )
        ranges = inside.groupBy("_src", F.substring("_order", 1, digits).alias("_next")).agg(
            F.sum("size").alias("_at_cut"), F.max("_need").alias("_need")
        )
        running = ranges.withColumn("_before", F.coalesce(F.sum("_at_cut").over(before), F.lit(0)))
        reached = (F.col("_before") <= F.col("_need")) & (
            F.col("_need") < F.col("_before") + F.col("_at_cut")
        )
        state = running.filter(reached).select(
            "_src",
            (F.col("_need") - F.col("_before")).alias("_need"),
            F.col("_next").alias("_cut"),
            "_at_cut",
        )
        known = digits
        if digits != PREFIXES[-1]:
            state = state.drop("_at_cut")
    return state.withColumnRenamed("_need", "_missing")


def part_taken() -> Column:
    """Words of the fractional repetition of a row."""
    at_cut = F.expr("size * _missing div greatest(_at_cut, 1)")
    return (
        F.when(F.col("_order") < F.col("_cut"), F.col("size"))
        .when(F.col("_order") == F.col("_cut"), at_cut)
        .otherwise(0)
        .cast("long")
    )


def mix_counts(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    narrow = checkpointed(sized(docs, seed))
    plan = source_plan(narrow, weights, cap)
    return narrow.join(small_side(plan), "_src").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("whole") + part_taken()).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = SEED
) -> DataFrame:
    """The mix itself: a document appears once per whole repetition and once for its fraction.

    A fraction smaller than the document holds its first words, joined by single spaces.
    """
    narrow = checkpointed(sized(docs, seed))
    plan = source_plan(narrow, weights, cap).drop("source_size", "target")
    rows = docs.select(
        F.struct("*").alias("_row"),
        source_key().alias("_src"),
        seeded_order(seed).alias("_order"),
        word_count(text_of()).alias("size"),
    )
    part = part_taken()
    parts = F.concat(
        F.array_repeat(F.col("size"), F.col("whole").cast("int")),
        F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")),
    )
    taken = rows.join(small_side(plan), "_src").withColumn("_words", F.explode(parts))
    cut = F.array_join(F.slice(words(text_of("_row.text")), 1, F.col("_words").cast("int")), " ")
    text = F.when(F.col("_words") == F.col("size"), F.col("_row.text")).otherwise(cut)
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length(text).cast("long")
    return taken.select(*[columns.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
