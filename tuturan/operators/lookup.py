"""Dictionary lookup where the rows lie: no text is shuffled.

A dictionary that proves small becomes one value, an array of strings addressed by the hash of a
word, each holding the few words of its bucket with their values between control characters. Every
task holds it, and the words of a text are looked up inside their row. A dictionary that is larger
is first cut down to the words that the texts use (distinct words meet after they were made distinct
in the tasks). What is larger still is for a join of exploded words, or for parts of the rows with the
entries of their own words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tuturan.session import store

TABLE_BYTES = 24 << 20  # of a dictionary that every task holds
ENTRY_BYTES = 16  # of an entry besides its characters
ENTRIES_A_BUCKET = 8
OPEN, CLOSE = "\x01", "\x02"  # before a word, and between it and its value
PART_TEXT = 16 << 20  # bytes of text whose words' entries a task holds together
TASK_BITS = 33  # below them stands the number of a row within the task that wrote it


def _measured(entries: DataFrame) -> tuple[int, int, bool]:
    """Rows and bytes of a written table of ``word`` and ``value``, and whether it holds no mark."""
    size = F.octet_length("word") + F.octet_length("value") + ENTRY_BYTES
    marked = F.concat("word", "value").rlike(f"[{OPEN}{CLOSE}]")
    n, total, marks = entries.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(size.cast("bigint")), F.lit(0)), F.count_if(marked)
    ).first()
    return n, total, marks == 0


def used_entries(entries: DataFrame, words: DataFrame) -> DataFrame:
    """The entries whose word is among ``words`` (a column ``word``, repeats allowed)."""
    return entries.join(words.select("word").distinct(), "word", "left_semi")


def small_table(
    entries: DataFrame, words: DataFrame | None, limit: int = TABLE_BYTES
) -> tuple[Column, int] | None:
    """The buckets, a column to put into the row of a projection, and their number; None beyond the
    limit, and for a dictionary that holds one of the two control characters.

    ``entries``: distinct ``word`` with a ``value``, neither null, as a written table. ``words``: all
    words that will be asked, read only where the dictionary is over the limit; without them it is not
    cut down.
    """
    n, size, plain = _measured(entries)
    if plain and size > limit and words is not None:
        entries = store(used_entries(entries, words), "used")
        n, size, plain = _measured(entries)
    if size > limit or not plain:
        return None
    buckets = 1 << max(4, (n // ENTRIES_A_BUCKET).bit_length())
    entry = F.concat(F.lit(OPEN), "word", F.lit(CLOSE), "value")
    filled = entries.groupBy(bucket_of(F.col("word"), buckets).alias("bucket")).agg(
        F.concat(F.array_join(F.collect_list(entry), ""), F.lit(OPEN)).alias("held")
    )
    every = entries.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit("").alias("held"))
    listed = filled.unionByName(every).groupBy("bucket").agg(F.max("held").alias("held"))
    in_order = F.array_sort(F.collect_list(F.struct("bucket", "held")))
    return listed.agg(F.transform(in_order, lambda b: b["held"])).scalar(), buckets


def in_parts(df: DataFrame, text: str) -> tuple[DataFrame, Column, int]:
    """The rows as a written table, the part of each row, and a number of partitions for the parts.

    A part is what a few neighbouring tasks wrote, or a stretch of what one wrote, of about
    ``PART_TEXT`` bytes of text. Rows are numbered as they are written, so that every pass and a task
    that runs twice find the same parts.
    """
    rows = store(df.withColumn("_row", F.monotonically_increasing_id()), "numbered", tidy=True)
    task = F.shiftright("_row", TASK_BITS)
    n, size, last = rows.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text).cast("bigint")), F.lit(0)), F.coalesce(F.max(task), F.lit(0))
    ).first()
    tasks = last + 1
    parts = max(math.ceil(size / PART_TEXT), min(2 * df.sparkSession.sparkContext.defaultParallelism, tasks))
    together, stretch = max(1, tasks // parts), max(1, math.ceil(n / parts))
    within = F.col("_row").bitwiseAND((1 << TASK_BITS) - 1)
    part = F.floor(task / together) + F.floor(within / stretch)
    return rows, part.cast("int"), max(parts, math.ceil(tasks / together))


def bucket_of(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def _mark(word: Column) -> Column:
    return F.concat(F.lit(OPEN), word, F.lit(CLOSE))


def is_known(table: Column, buckets: int, word: Column) -> Column:
    """Does the dictionary hold a word? ``table`` is a column of the row."""
    found = F.contains(F.get(table, bucket_of(word, buckets)), _mark(word))
    return found & ~F.contains(word, F.lit(CLOSE))


def looked_up(table: Column, buckets: int, word: Column) -> Column:
    """The value of a word, null where it has none. ``table`` is a column of the row."""
    held = F.get(table, bucket_of(word, buckets))
    after = F.call_function("substring_index", held, _mark(word), F.lit(-1))
    return F.when(is_known(table, buckets, word), F.substring_index(after, OPEN, 1))
