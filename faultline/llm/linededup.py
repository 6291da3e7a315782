"""Line dedup: later copies of repeated line runs are deleted.

The lines with a word of all different texts, in the order of the ids, form one
sequence of line ids; a position never runs over the end of its document. Prefix
doubling sorts the suffixes of this sequence: the rank at level k orders them by
their first 2^k lines, level k + 1 comes from the pairs of ranks at p and
p + 2^k, and only positions whose rank is shared stay active, for a unique
prefix repeats nowhere.

The suffixes that share their first d lines are one longest-common-prefix
interval. Two ranks that overlap name it: those of level k at the first and at
the last 2^k of the d lines. A run is repeated when an earlier suffix lies in its
interval. The intervals asked for are the shortest runs with ``min_words`` words
that begin, and those that end, at each position: every maximal repeated run with
so many words is the union of these, and a run with fewer words is left alone.
All copies but the first of a run go. Doubling ends at the longest run asked for.

Equal texts are one text here, that of the smallest id; its other copies go as a
whole when they have ``min_words`` words. So a group of copies, however large,
adds one text to the sequence.

Defined results: texts are cut at line feeds only; a line without a word is no
part of a run and goes or stays with the line before it, at the top with the
first line that has one; lines left over are joined by line feeds, and a text
that loses all lines becomes empty; a null text stays null; null ids come last;
rows equal in id and text count as copies in any order; runs may overlap their
own copy inside a text. Other columns pass through; ``n_chars`` is set anew.
"""

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.ordering import with_row_numbers
from faultline.functions.text import let
from faultline.llm.common import text_of, word_count
from faultline.sources.checkpoints import checkpoint_dir, checkpointed

MIN_WORDS = 50
TEXT = ["_f1", "_f2"]  # a text by two independent 64-bit hashes
LARGEST = (1 << 63) - 1


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_f1"), F.xxhash64(F.lit(1), text).alias("_f2")]


def order_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LARGEST)).alias("_id")


def line_sequence(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first copy of every text, and its lines with a word numbered over all texts."""
    first = keyed.groupBy(*TEXT).agg(F.min("_id").alias("_id"))
    lines = keyed.select(
        *TEXT, "_id", F.posexplode(F.split(text_of("_text"), "\n")).alias("line_no", "line")
    ).select(
        *TEXT,
        "_id",
        "line_no",
        F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(1), "line").alias("h2"),
        word_count(F.col("line")).alias("words"),
    )
    own = lines.filter("words > 0").join(first, [*TEXT, "_id"], "left_semi").distinct()
    return first, with_row_numbers(own, ["_id", *TEXT, "line_no"], "pos")


def numbered(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks of the keys that occur more than once, in the order of the keys."""
    shared = groups.groupBy(*keys).count().filter("count > 1").select(*keys)
    return with_row_numbers(shared, keys, "rank")


def asked_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(start, end): the shortest runs of ``min_words`` words from and up to each position."""
    doc = Window.partitionBy(*TEXT)
    running = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = lines.withColumn("to", F.sum("words").over(running)).withColumn(
        "before", F.col("to") - F.col("words")
    )
    ahead = doc.orderBy("before").rangeBetween(Window.currentRow, min_words - 1)
    behind = doc.orderBy("to").rangeBetween(-(min_words - 1), Window.currentRow)
    found = summed.select(
        "pos",
        F.when(F.max("to").over(ahead) >= F.col("before") + min_words, F.max("pos").over(ahead)).alias("last"),
        F.when(F.col("to") >= min_words, F.min("pos").over(behind)).alias("first"),
    )
    forward = found.filter("last IS NOT NULL").select(F.col("pos").alias("start"), F.col("last").alias("end"))
    backward = found.filter("first IS NOT NULL").select(F.col("first").alias("start"), F.col("pos").alias("end"))
    return forward.unionByName(backward)


def later_copies(lines: DataFrame, min_words: int) -> DataFrame:
    """(start, end) of the asked runs that an earlier suffix shares.

    Every level adds its copies to a table in the shared folder, two numbers a row, so no
    plan holds two levels.
    """
    ids = numbered(lines, ["h1", "h2"])
    ranks = checkpointed(lines.join(ids, ["h1", "h2"]).select("pos", *TEXT, "rank"))
    ends = ranks.select(F.col("pos").alias("end"))
    asked = asked_runs(lines, min_words).join(
        ranks.select(F.col("pos").alias("start")), "start", "left_semi"
    )
    asked = checkpointed(asked.join(ends, "end", "left_semi").distinct())
    longest = asked.agg(F.max(F.col("end") - F.col("start") + 1)).first()[0] or 0
    table, width = f"{checkpoint_dir(lines.sparkSession)}/copies-{uuid4().hex}", 1
    asked.filter("false").select("start", "end").write.parquet(table)
    while width <= longest:
        length = F.col("end") - F.col("start") + 1
        level = asked.filter((length >= width) & (length < 2 * width))
        head = ranks.select(F.col("pos").alias("start"), F.col("rank").alias("head"))
        tail = ranks.select((F.col("pos") + (width - 1)).alias("end"), F.col("rank").alias("tail"))
        named = level.join(head, "start").join(tail, "end").withColumn("length", length)
        interval = ["length", "head", "tail"]
        earliest = named.groupBy(*interval).agg(F.min("start").alias("first"))
        copies = named.join(earliest, interval).filter("start > first").select("start", "end")
        copies.write.mode("append").parquet(table)
        if 2 * width > longest:
            break
        after = ranks.select(
            (F.col("pos") - width).alias("pos"), *TEXT, F.col("rank").alias("next")
        )
        pairs = checkpointed(ranks.withColumnRenamed("rank", "head").join(after, ["pos", *TEXT]))
        doubled = numbered(pairs, ["head", "next"])
        ranks = checkpointed(pairs.join(doubled, ["head", "next"]).select("pos", *TEXT, "rank"))
        width *= 2
    return lines.sparkSession.read.parquet(table)


def kept_spans(lines: DataFrame, copies: DataFrame) -> DataFrame:
    """For each text that loses lines: its kept line ranges (from, to) in order."""
    reach = copies.groupBy(F.col("start").alias("pos")).agg(F.max("end").alias("end"))
    doc = Window.partitionBy(*TEXT).orderBy("pos")
    so_far = doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.select("pos", *TEXT, "line_no").join(reach, "pos", "left")
    marked = marked.withColumn("gone", F.coalesce(F.max("end").over(so_far) >= F.col("pos"), F.lit(False)))
    spans = (
        marked.withColumn("island", F.sum(F.col("gone").cast("long")).over(so_far))
        .withColumn("to", F.coalesce(F.lead("line_no").over(doc) - 1, F.lit((1 << 31) - 2)))
        .withColumn("from", F.when(F.row_number().over(doc) == 1, 0).otherwise(F.col("line_no")))
        .groupBy(*TEXT, "island")
        .agg(
            F.min(F.when(~F.col("gone"), F.col("from"))).alias("from"),
            F.max(F.when(~F.col("gone"), F.col("to"))).alias("to"),
            F.max("gone").alias("lost"),
        )
    )
    return (
        spans.groupBy(*TEXT)
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("from").isNotNull(), F.struct("from", "to")))).alias("kept"),
            F.max("lost").alias("lost"),
        )
        .filter("lost")
        .drop("lost")
    )


def with_kept_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row as ``_row`` with its text after the dedup in ``_kept`` and both line counts."""
    keyed = docs.select(
        F.col("text").alias("_text"), *text_key(text_of()), order_id()
    )
    first, lines = line_sequence(keyed)  # the numbering has stored them
    spans = None
    if not lines.isEmpty():
        spans = checkpointed(kept_spans(lines, later_copies(lines, min_words)))
    decided = first.withColumn("_first", F.lit(True))
    if spans is None:
        decided = decided.withColumn("kept", F.lit(None).cast("array<struct<from:int,to:int>>"))
    else:
        decided = checkpointed(decided.join(spans, TEXT, "left"))
    again = Window.partitionBy(*TEXT, "_id").orderBy("_f1")
    rows = docs.select(F.struct("*").alias("_row"), *text_key(text_of()), order_id())
    rows = rows.withColumn("_copy", F.row_number().over(again)).join(decided, [*TEXT, "_id"], "left")
    text = F.col("_row.text")
    cut = let(
        F.split(text, "\n"),
        lambda lines: F.array_join(
            F.flatten(
                F.transform("kept", lambda s: F.slice(lines, s["from"] + 1, s["to"] - s["from"] + 1))
            ),
            "\n",
        ),
    )
    later = ~F.coalesce("_first", F.lit(False)) | (F.col("_copy") > 1)
    cut_text = (
        F.when(later & (word_count(text_of("_row.text")) >= min_words), "")
        .when(~later & F.col("kept").isNotNull(), cut)
        .otherwise(text)
    )
    return rows.withColumn("_kept", cut_text)


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The same rows and columns, with the lines of later copies deleted from the texts."""
    done = with_kept_lines(docs, min_words)
    return picked(done, docs.columns)


def picked(done: DataFrame, names: list[str]) -> DataFrame:
    columns = {"text": F.col("_kept"), "n_chars": F.length("_kept").cast("long")}
    return done.select(*[columns.get(c, F.col(f"_row.`{c}`")).alias(c) for c in names])


def remaining(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """As ``deduplicated``, without the documents that lost their whole text."""
    done = with_kept_lines(docs, min_words)
    lost = (F.col("_kept") == "") & (F.col("_row.text") != "")
    return picked(done.filter(~F.coalesce(lost, F.lit(False))), docs.columns)


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, lines before and after, and the SHA-256 of the text left."""

    def count(name: str) -> Column:
        text = F.coalesce(F.col(name), F.lit(""))
        return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).cast("long")

    return with_kept_lines(docs.select("doc_id", "text"), min_words).select(
        F.col("_row.doc_id").alias("doc_id"),
        count("_row.text").alias("n_lines"),
        count("_kept").alias("n_kept"),
        F.sha2(F.coalesce("_kept", F.lit("")), 256).alias("text_sha256"),
    )
