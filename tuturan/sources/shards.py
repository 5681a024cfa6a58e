"""Shard sets: which files make up a corpus, whether any is missing, and which sets belong together.

A shard is a Parquet file, or a folder of Parquet files as Spark writes it, named
``<corpus>-<number>-of-<count>.parquet``, both numbers of five digits. Further marks after the count
tell several files of one shard apart. A name without numbers is a corpus of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tuturan.sources.inventory import list_files, qualified

SHARD_NAME = r"^(.+?)-(\d{5})-of-(\d{5})(?:[.\-_].*)?$"
LAST_NAME = r"\.parquet$"
REPORTED = 10  # sets named in an error


class MissingShards(ValueError):
    """A corpus lacks some of the shards that its file names promise."""


def shard_name(entry: Column) -> Column:
    """Corpus of a shard's name, with or without the ending."""
    plain = F.regexp_replace(entry, LAST_NAME, "")
    found = F.regexp_extract(plain, SHARD_NAME, 1)
    return F.when(found != "", found).otherwise(plain)


def _number(entry: Column, group: int) -> Column:
    return F.regexp_extract(entry, SHARD_NAME, group).try_cast("int")


def _below(path: Column, root: str) -> Column:
    """The part of a path below a folder, whatever way its scheme is written."""
    return F.substring_index(path, f"/{root.rsplit('/', 1)[-1]}/", -1)


def entry_of_row(root: str) -> Column:
    """Name of the shard from which a row was read."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.split_part(_below(path, root), F.lit("/"), F.lit(1))


def with_shard(files: DataFrame) -> DataFrame:
    """Add ``corpus``, ``shard`` and ``shards`` as the name in ``entry`` gives them."""
    return files.withColumns(
        {
            "corpus": shard_name(F.col("entry")),
            "shard": _number(F.col("entry"), 2),
            "shards": _number(F.col("entry"), 3),
        }
    )


def shard_files(spark: SparkSession, folder: str) -> DataFrame:
    """The file table of a folder: ``path``, ``length``, ``entry`` (name of the shard's file or
    folder), ``corpus``, ``shard`` and ``shards`` (null without numbers).

    Files in deeper folders than a shard's own do not count.
    """
    root = qualified(spark, folder)
    below = _below(F.col("path"), root)
    listed = list_files(spark, folder, "*.parquet").withColumn("_parts", F.split(below, "/"))
    own = (F.size("_parts") == 1) | ((F.size("_parts") == 2) & F.col("_parts")[0].endswith(".parquet"))
    return with_shard(listed.where(own).withColumn("entry", F.col("_parts")[0]).drop("_parts"))


def shard_sets(files: DataFrame) -> DataFrame:
    """One row a corpus: ``entries``, ``files``, ``bytes``, ``shards`` (largest count named),
    ``missing`` (numbers of absent shards) and ``mixed`` (several counts, or numbers and none)."""
    sets = files.groupBy("corpus").agg(
        F.sort_array(F.collect_set("entry")).alias("entries"),
        F.count(F.lit(1)).alias("files"),
        F.sum("length").alias("bytes"),
        F.max("shards").alias("shards"),
        F.collect_set("shard").alias("_found"),
        (F.count_distinct("shards") + F.max(F.col("shards").isNull().cast("int")) > 1).alias("mixed"),
    )
    wanted = F.when(F.col("shards") > 0, F.sequence(F.lit(0), F.col("shards") - 1))
    missing = F.coalesce(F.array_except(wanted, "_found"), F.array().cast("array<int>"))
    return sets.withColumn("missing", F.sort_array(missing)).drop("_found")


def require_complete(sets: DataFrame) -> DataFrame:
    """The sets themselves; ``MissingShards`` when one lacks a shard or mixes two splits."""
    bad = sets.where((F.size("missing") > 0) | F.col("mixed")).orderBy("corpus").limit(REPORTED).collect()
    if bad:
        told = [
            f"{r['corpus']} mixes several splits"
            if r["mixed"]
            else f"{r['corpus']} lacks {', '.join(f'{k:05}' for k in r['missing'][:REPORTED])} of {r['shards']:05}"
            for r in bad
        ]
        raise MissingShards("; ".join(told))
    return sets


def choose_sets(files: DataFrame, corpora: Sequence[str] | None) -> DataFrame:
    """The complete sets of the named corpora, or of all; an error when none of the names occurs."""
    if corpora:
        files = files.where(F.col("corpus").isin(*corpora))
    sets = require_complete(shard_sets(files))
    if sets.isEmpty():
        raise ValueError(f"no shards of {list(corpora)}" if corpora else "no shards")
    return sets


def read_sets(
    spark: SparkSession, folder: str, entries: DataFrame, schema: str, also: Sequence[Column] = ()
) -> DataFrame:
    """The rows of the shards in ``entry``, with that name and the columns ``also``. The names, which
    a reader needs in any case, are all that comes to the driver."""
    root = qualified(spark, folder)
    names = sorted(r[0] for r in entries.select("entry").distinct().collect())
    if not names:
        raw = spark.createDataFrame([], schema)
        return raw.select("*", F.lit("").alias("entry"), *[F.lit(None).alias(f"_also{i}") for i in range(len(also))])
    raw = spark.read.schema(schema).parquet(*[f"{root}/{n}" for n in names])
    return raw.select("*", entry_of_row(root).alias("entry"), *[c.alias(f"_also{i}") for i, c in enumerate(also)])


def set_kind(corpus: Column) -> tuple[Column, Column]:
    """Base name and kind (segments, words) of a set; noise sets without a kind have none."""
    words = corpus.rlike("(_words|_word_timestamp)$")
    segments = corpus.rlike("(_segments|_segment_timestamp)$")
    noise = F.contains(corpus, F.lit("noise")) | F.contains(corpus, F.lit("audioset"))
    kind = F.when(segments, "segments").when(words, "words").when(~noise, "segments")
    base = (
        F.when(segments, F.regexp_replace(corpus, "_segments|_segment_timestamp", ""))
        .when(words, F.regexp_replace(corpus, "_words|_word_timestamp", ""))
        .otherwise(corpus)
    )
    return base, kind


def pair_sets(sets: DataFrame) -> DataFrame:
    """One row a base: ``base``, ``segments`` and ``words``, the shards of its two sets (no words:
    null). Where a base has several sets of a kind, one with a suffix wins, then the last by name.
    """
    base, kind = set_kind(F.col("corpus"))
    typed = sets.withColumns({"base": base, "kind": kind}).where(F.col("kind").isNotNull())
    best = F.max_by("entries", F.struct(F.col("corpus") != F.col("base"), "corpus"))
    one = lambda k: typed.where(F.col("kind") == k).groupBy("base").agg(best.alias(k))
    return one("segments").join(one("words"), "base", "left")
