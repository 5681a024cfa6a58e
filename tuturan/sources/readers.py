"""Readers for corpora, manifests, keyed text, benchmark tables, hypotheses and audio."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tuturan.functions.arrow import read_wav_headers
from tuturan.functions.expr import SPACE, is_blank, strip
from tuturan.functions.text import marker_duration, marker_language, strip_markers
from tuturan.operators.filters import stem, with_text
from tuturan.operators.joins import attach_durations, word_durations
from tuturan.operators.stats import require_unique
from tuturan.session import store
from tuturan.sources import rejects, shards
from tuturan.sources.inventory import list_files

TAGGED = "audio_filename string, segment_timestamp string"
PAIRED = "audio_filename string, new_text string"
MANIFEST = "audio_filepath string, text string, duration double"
SPEAKER_MANIFEST = MANIFEST + ", speaker int, language string"
BENCHMARK = "utterance_id string, path string, sentence string, duration string"
CONVERSATION = (
    "uid string, conversation array<struct<text: string,"
    " metadata: struct<start_time: double, end_time: double>>>"
)
HYPOTHESIS = "text string, text_norm string"
SYNTHESIS_FIELDS = {
    "text": "string",
    "type": "string",
    "person": "string",
    "audio_path": "string",
    "voice_id": "string",
    "index": "bigint",
    "duration": "double",
}


def shard_source(file_name: Column) -> Column:
    """Corpus name of a shard file: what comes before its number."""
    return shards.shard_name(file_name)


def pick_sources(df: DataFrame, datasets: Sequence[str] | None, col: str = "source") -> DataFrame:
    """Keep the named corpora; an error when none of them occurs."""
    if not datasets:
        return df
    kept = df.where(F.col(col).isin(*datasets))
    if kept.isEmpty():
        raise ValueError(f"no rows for {list(datasets)}")
    return kept


def tagged_corpus(tagged: DataFrame) -> DataFrame:
    """Tagged segments → working columns; rows without file or text are dropped."""
    tags = F.col("segment_timestamp")
    present = tagged.where(F.col("audio_filename").isNotNull() & tags.isNotNull())
    return with_text(present, strip_markers(tags), lambda t: t != "").select(
        "audio_filename",
        "text",
        marker_duration(tags).alias("duration"),
        "source",
        marker_language(tags).alias("language"),
    )


def read_tagged(
    spark: SparkSession, folder: str, datasets: Sequence[str] | None = None
) -> DataFrame:
    """All shards of a folder, or of the named corpora; a corpus that lacks a shard is an error.

    Corpora are chosen by the table of files, before any row is read.
    """
    sets = shards.choose_sets(shards.shard_files(spark, folder), datasets)
    raw = shards.read_sets(spark, folder, sets.select(F.explode("entries").alias("entry")), TAGGED)
    return tagged_corpus(raw.withColumn("source", shards.shard_name(F.col("entry"))))


def read_paired(
    spark: SparkSession, folder: str, datasets: Sequence[str] | None = None
) -> DataFrame:
    """Segment text with durations from the word shards.

    Sets of shards are paired by the name of their corpus, noise sets left out first; each may have
    any number of shards. Both sides of all pairs are one scan each and meet in one join.
    """
    sets = shards.shard_sets(shards.shard_files(spark, folder))
    pairs = pick_sources(shards.pair_sets(shards.require_complete(sets)), datasets, "base")
    pairs = store(pairs, "pairs")  # one row a corpus, asked four times
    segment_files = pairs.select("base", F.explode("segments").alias("entry"))
    word_files = pairs.select("base", F.explode("words").alias("entry"))

    def rows(entries: DataFrame, also: Sequence[Column] = ()) -> DataFrame:
        read = shards.read_sets(spark, folder, entries, PAIRED, also)
        return read.join(entries.withColumnRenamed("base", "source"), "entry")

    segments = paired_segments(rows(segment_files), keep=("source",))
    timed = rows(word_files, [input_position()])
    words = word_durations(timed, order=F.col("_also0"), by=("source",))
    return attach_durations(segments, words, ("source", "audio_filename"))


def paired_segments(
    raw: DataFrame, text: str = "new_text", keep: Sequence[str] = ()
) -> DataFrame:
    """Clean segment text; rows without file or text are dropped."""
    present = raw.where(F.col("audio_filename").isNotNull() & (F.length(text) > 0))
    cleaned = with_text(present, strip_markers(F.col(text)), lambda t: t != "")
    return cleaned.select("audio_filename", "text", *keep)


def input_position() -> Column:
    """Order of rows as they lie in the files: file, block, row."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_json_records(
    spark: SparkSession, path: str, fields: dict[str, str] = SYNTHESIS_FIELDS
) -> DataFrame:
    """A JSON array of records or ``{"results": [...]}``, whichever a file holds.

    Spark reads the elements of a bare array as rows; a wrapped file is one row with its list.
    """
    item = ", ".join(f"{name}: {kind}" for name, kind in fields.items())
    bare = ", ".join(f"{name} {kind}" for name, kind in fields.items())
    raw = (
        spark.read.schema(f"results array<struct<{item}>>, {bare}")
        .option("multiLine", "true")
        .json(path)
    )
    single = F.array(F.struct(*fields))
    return raw.select(F.inline(F.coalesce("results", single)))


def read_csv_records(spark: SparkSession, path: str, fields: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header: all columns as text or, with ``fields``, typed rows without the malformed ones."""
    if fields is None:
        return spark.read.option("header", "true").csv(path)
    return rejects.accepted(rejects.checked_csv(spark, path, ", ".join(f"{n} {k}" for n, k in fields.items())))


def read_manifest(
    spark: SparkSession, path: str | Sequence[str], schema: str = MANIFEST
) -> DataFrame:
    """JSON lines; blank lines are ignored and broken ones skipped. ``rejects.checked_json`` has these."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_keyed_text(spark: SparkSession, path: str, name: str, keep_empty: bool) -> DataFrame:
    """``id rest`` lines; the last line of an id wins, a lone id is empty text or left out."""
    line = strip(F.col("value"))
    parts = F.split(line, rf"{SPACE}+", 2)
    rows = (
        spark.read.text(path)
        .select(line.alias("value"), input_position().alias("at"))
        .where(F.col("value") != "")
        .select(parts[0].alias("utt_id"), F.coalesce(F.get(parts, 1), F.lit("")).alias(name), "at")
    )
    if not keep_empty:
        rows = rows.where(F.col(name) != "")
    return rows.groupBy("utt_id").agg(F.max_by(name, "at").alias(name))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return read_keyed_text(spark, path, "text", keep_empty=True)


def read_audio_paths(spark: SparkSession, path: str) -> DataFrame:
    return read_keyed_text(spark, path, "audio_path", keep_empty=False)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark TSV; the id is the stem of the audio path and must not repeat."""
    raw = spark.read.schema(BENCHMARK).option("sep", "\t").option("header", "true").csv(path)
    rows = raw.withColumn("utterance_id", stem(F.col("path")))
    return require_unique(rows, "utterance_id")


def read_hypotheses(spark: SparkSession, folder: str, partition: str | None = None) -> DataFrame:
    """One JSON file per utterance; broken files are skipped.

    The id is the name of the file or, as Spark itself writes such files, the folder of a
    ``partition`` column.
    """
    schema = HYPOTHESIS if partition is None else f"{HYPOTHESIS}, {partition} string"
    raw = (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .option("mode", "DROPMALFORMED")
        .json(folder)
    )
    return raw.select(
        (F.col(partition) if partition else stem(F.col("_metadata.file_name"))).alias("utterance_id"),
        F.coalesce("text_norm", F.lit("")).alias("hypothesis"),
    )


def conversation_rows(parsed: DataFrame, audio: str = "audio") -> DataFrame:
    """Turn 0 carries the times, turn 1 the transcript; shorter or silent ones are dropped."""
    turn = lambda i: F.get("conversation", i)
    meta = turn(0)["metadata"]
    zero = F.lit(0.0)
    seconds = F.coalesce(meta["end_time"], zero) - F.coalesce(meta["start_time"], zero)
    return (
        parsed.where(F.size("conversation") >= 2)
        .select(
            F.col("uid").alias("utterance_id"),
            F.concat(F.lit(audio + "/"), F.col("uid"), F.lit(".wav")).alias("path"),
            strip(turn(1)["text"]).alias("sentence"),
            seconds.alias("duration"),
        )
        .where(~is_blank(F.col("sentence")))
    )


def read_conversations(spark: SparkSession, path: str, audio: str = "audio") -> DataFrame:
    """Conversation JSON lines."""
    parsed = spark.read.schema(CONVERSATION).option("mode", "DROPMALFORMED").json(path)
    return conversation_rows(parsed, audio)


def audio_inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Path and size of every audio file, listed by the executors; the contents are not read."""
    return list_files(spark, folder, pattern)


def audio_headers(
    spark: SparkSession, folder: str, low: float = 3.0, high: float = 15.0, pattern: str = "*.wav"
) -> DataFrame:
    """Duration, sample rate, channels and problems of every PCM file."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
    )
    return read_wav_headers(files, low, high)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """``{"categories": {name: [template, ...]}}`` → one row per template."""
    raw = spark.read.text(path, wholetext=True)
    categories = F.from_json("value", "struct<categories: map<string, array<string>>>")["categories"]
    return flatten_templates(raw.select(categories.alias("categories")))


def flatten_templates(df: DataFrame) -> DataFrame:
    listed = df.select(F.explode("categories").alias("category", "templates"))
    return listed.select("category", F.posexplode("templates").alias("position", "template"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``WORD phonemes`` lines, words lower-cased, last line of a word wins."""
    line = strip(F.col("value"))
    rows = (
        spark.read.text(path)
        .select(line.alias("value"), input_position().alias("at"))
        .where(F.contains("value", F.lit(" ")))
        .select(
            F.lower(F.substring_index("value", " ", 1)).alias("word"),
            F.regexp_replace("value", "^[^ ]* ", "").alias("phonemes"),
            "at",
        )
    )
    return rows.groupBy("word").agg(F.max_by("phonemes", "at").alias("phonemes"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``token<TAB>score`` lines."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(
        parts[0].alias("token"), F.get(parts, 1).try_cast("double").alias("score")
    )


def folder_audit(corpus: DataFrame, inventory: DataFrame, file: str = "audio_filename") -> DataFrame:
    """First path segment of every file: rows that need it, whether the folder exists."""
    needed = corpus.groupBy(F.split_part(file, F.lit("/"), F.lit(1)).alias("folder")).agg(
        F.count(F.lit(1)).alias("files")
    )
    found = inventory.select("folder", F.lit(True).alias("_found")).distinct()
    return needed.join(found, "folder", "left").select(
        "folder", "files", F.coalesce("_found", F.lit(False)).alias("present")
    )


def parse_spec(spec: Column) -> tuple[Column, Column]:
    """``path:max`` → path and maximum (null without one)."""
    limit = F.regexp_extract(spec, r":(\d+)$", 1)
    return F.regexp_replace(spec, r":\d+$", ""), limit.try_cast("bigint")
