"""URL filters: rules first, then the ratio of two character models.

Rules name a host and the start of a path; the longest that fits decides. The URLs they
decide teach two models, one of accepted and one of rejected URLs, and the models judge
the URLs no rule fits.

A model is a Markov model of variable order over the characters behind ``://``: the
chance of a character after a context is smoothed with the chance after the context
without its first character (Witten and Bell: ``(c + t * lower) / (n + t)``, where ``c``
counts the character after the context, ``n`` all and ``t`` the different characters
after it), down to equal chances for all ``ALPHABET`` characters. A context the model
has not met adds nothing, so each character is judged by the longest contexts known.

Contexts are grams of ``ORDER + 1`` characters counted for all URLs at once. The counts
of shorter grams are sums of those of longer ones, so every order is made from the one
above it, and the chances go back up, each gram joined with the one without its first
character. A gram has at most ``ALPHABET`` children, so no join is skewed. The
logarithm of the ratio of the two chances is kept per gram as a whole number
(millionths), and a URL's score is their sum over its length. Grams that are frequent
beyond a fixed share of all are broadcast, the others are joined by shuffle.

The mark is calibrated on the labelled URLs left out of training (a fifth, by a
checksum of the URL): the mean log ratio from which on fewest are misjudged, both sides
weighing the same, in the middle of the free interval below it.

Defined results: a null URL and one without ``://`` have an empty host and path, and no
characters; their score is null and they are blocked; with no accepted or no rejected
URL to train on, nothing is learned: scores are zero and the other URLs are allowed;
without a labelled URL left to calibrate on, for one of the two, the mark is zero.
Characters outside printable ASCII count as one character.
Equal URLs teach once and are judged alike; repeated rows stay. Other columns are not
read. A very long URL is read in linear time; its grams carry a number, not its text.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import with_values
from faultline.sources.checkpoints import checkpointed

# (rule, whether it blocks)
RULES = [("net/", True), ("example.net/en/", False), ("example.com/de/", True), ("org/fr/", False)]
ORDER = 4  # characters of context
ALPHABET = 71  # printable ASCII without A-Z, one for the rest, one for the end
FOLDS = 5
MICRO = 1_000_000
STEP = 10_000  # marks are looked for in steps of a hundredth
START, END, OTHER = "\x02", "\x03", "\x04"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def behind_scheme(url: str = "url") -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.coalesce(F.instr(F.col(url), "://"), F.lit(0))
    return F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")


def host_of(rest: Column) -> Column:
    return lowered(F.regexp_extract(rest, r"^[^/?#]*", 0))


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, bool]] = RULES) -> Column:
    """The longest rule that fits (the last by text among equally long ones); null without one."""
    chosen = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        chosen = F.when(fits, rule).otherwise(chosen)
    return chosen


def blocks(rule: Column, rules: list[tuple[str, bool]] = RULES) -> Column:
    return rule.isin([r for r, blocked in rules if blocked])


def characters(rest: Column, order: int) -> Column:
    """The text as the models read it, behind ``order`` signs of the start."""
    plain = F.regexp_replace(lowered(rest), r"[^\x20-\x7e]", OTHER)
    return F.concat(F.lit(START * order), plain, F.lit(END))


def grams(text: Column, order: int) -> Column:
    """Every character with the ``order`` before it, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?=(.{{{order + 1}}}))"), F.lit(1))


def shorter(counts: DataFrame) -> DataFrame:
    """Counts of the grams without their first character."""
    return counts.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")
    )


def chances(counts: DataFrame, below: DataFrame | None) -> DataFrame:
    """The smoothed chance of the last character of each gram, in both models."""
    context = Window.partitionBy(F.expr("substring(gram, 1, length(gram) - 1)"))  # at most ALPHABET rows
    if below is None:
        lower = counts.select("*", *[F.lit(1.0 / ALPHABET).alias(f"lower_{m}") for m in ("accepted", "rejected")])
    else:
        lower = counts.withColumn("_tail", F.expr("substring(gram, 2)")).join(
            below.select(
                F.col("gram").alias("_tail"), F.col("p_accepted").alias("lower_accepted"),
                F.col("p_rejected").alias("lower_rejected"),
            ),
            "_tail",
        )

    def smoothed(model):
        count, before = F.col(model), F.col(f"lower_{model}")
        met = F.sum(count).over(context).cast("double")
        kinds = F.count_if(count > 0).over(context).cast("double")
        return F.when(met > 0, (count.cast("double") + kinds * before) / (met + kinds)).otherwise(before)

    return lower.select(
        "gram", "accepted", "rejected",
        smoothed("accepted").alias("p_accepted"), smoothed("rejected").alias("p_rejected"),
    )


def log_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, ratio (whole millionths of the natural logarithm) for grams with counts in both models."""
    levels = [counts.select("gram", "accepted", "rejected")]
    for _ in range(order):
        levels.append(checkpointed(shorter(levels[-1])))
    below = None
    for level in reversed(levels):
        below = checkpointed(chances(level, below))
    ratio = F.log(F.col("p_accepted") / F.col("p_rejected"))
    return below.select("gram", F.round(ratio * MICRO).cast("long").alias("ratio"))


def mark(held_out: DataFrame) -> DataFrame:
    """The step from which on URLs are accepted: one row. Held out: step, is_accepted.

    One row per step and sums over the steps; steps are few, as chances have a lower bound.
    """
    steps = held_out.groupBy("step").agg(
        F.count_if("is_accepted").alias("good"), F.count_if(~F.col("is_accepted")).alias("bad")
    )
    upwards = Window.orderBy("step")
    below = upwards.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    missed = F.coalesce(F.sum("good").over(below), F.lit(0))  # accepted URLs below the step
    passed = F.sum("bad").over(whole) - F.coalesce(F.sum("bad").over(below), F.lit(0))
    good, bad = F.sum("good").over(whole), F.sum("bad").over(whole)
    errors = missed.cast("double") * bad + passed.cast("double") * good
    free = F.coalesce(F.lag("step").over(upwards) + 1, F.col("step"))
    both = F.when((good > 0) & (bad > 0), F.struct(errors.alias("errors"), "step", free.alias("free")))
    best = steps.select(both.alias("found")).agg(F.min("found").alias("b"))
    middle = F.ceil((F.col("b.step") + F.col("b.free")) / 2)
    return best.select(F.coalesce(middle, F.lit(0)).cast("long").alias("mark"))


def distinct_urls(pages: DataFrame, order: int) -> DataFrame:
    """Every URL once: a number, n (rows), label and fold, and what the models read (null without ``://``).

    To be checkpointed, as the numbers depend on the order of the rows.
    """
    rest = behind_scheme()
    once = pages.filter("url IS NOT NULL").groupBy("url").agg(F.count("*").alias("n"))
    rule = rule_of(host_of(rest), path_of(rest))
    return once.select(
        F.monotonically_increasing_id().alias("id"), "url", "n",
        (~blocks(rule)).alias("is_accepted"), (F.crc32("url") % FOLDS == 0).alias("held_out"),
        F.when(F.instr("url", "://") > 0, characters(rest, order)).alias("text"),
    )


def scored_urls(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """url, n, is_accepted, held_out, score: the mean log ratio in millionths, as a double."""
    taught = ~F.col("held_out")
    all_grams = urls.select("id", "is_accepted", "held_out", F.explode(grams(F.col("text"), order)).alias("gram"))
    counts = checkpointed(
        all_grams.groupBy("gram").agg(
            F.count("*").alias("n"),
            F.count_if(taught & F.col("is_accepted")).alias("accepted"),
            F.count_if(taught & ~F.col("is_accepted")).alias("rejected"),
        )
    )
    learned = counts.agg(F.max("accepted"), F.max("rejected")).first()
    if not (learned[0] and learned[1]):
        nothing = F.when(F.col("text").isNotNull(), 0.0)
        return urls.select("url", "n", "is_accepted", "held_out", nothing.alias("score"))
    weights = checkpointed(log_ratios(counts, order).join(counts.select("gram", "n"), "gram"))
    valued = with_values(all_grams.select("id", "gram"), weights, "gram")
    sums = valued.groupBy("id").agg(F.sum("ratio").alias("total"), F.count("*").alias("length"))
    score = F.col("total").cast("double") / F.col("length").cast("double")
    return urls.select("id", "url", "n", "is_accepted", "held_out").join(sums, "id", "left").select(
        "url", "n", "is_accepted", "held_out", score.alias("score")
    )


def judged_urls(pages: DataFrame, order: int = ORDER) -> DataFrame:
    """url, n, score (mean natural log ratio a character), and whether the models accept it."""
    urls = checkpointed(distinct_urls(pages, order))
    scored = checkpointed(scored_urls(urls, order))
    step = F.floor(F.col("score") / STEP).cast("long")
    least = mark(scored.filter("held_out AND is_accepted IS NOT NULL").select(step.alias("step"), "is_accepted"))
    return scored.select(
        "url", "n", (F.col("score") / MICRO).alias("score"), (step >= least.first()[0]).alias("passes")
    )


def url_report(pages: DataFrame, order: int = ORDER) -> DataFrame:
    """Per page: host, path, the rule that decides, the verdict, and the score of the models."""
    judged = checkpointed(judged_urls(pages, order))
    rest = behind_scheme()
    host, path = host_of(rest), path_of(rest)
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"), rule_of(host, path).alias("rule"))
    verdict = (
        F.when(blocks(F.col("rule")), "block").when(F.col("rule").isNotNull(), "allow")
        .when(F.col("passes"), "allow").otherwise("block")
    )
    return with_values(rows, judged, "url").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "score"
    )
