"""Joins on utterance, file and text keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tuturan.functions.expr import strip
from tuturan.functions.text import marker_duration
from tuturan.operators.ranks import seeded_sample

FOLD_KEY = "_fold"


def text_key(col: Column) -> Column:
    """Trimmed lower-case text, the identity of a sentence."""
    return F.lower(strip(col))


def text_digest(col: Column) -> Column:
    """The identity of a sentence in 256 bits: what is shuffled, compared and kept in state."""
    return F.unhex(F.sha2(text_key(col), 256))


def match_utterances(transcripts: DataFrame, audio: DataFrame, key: str = "utt_id") -> DataFrame:
    """Utterances that have both a transcript and an audio path."""
    return transcripts.join(audio, key)


def word_durations(
    words: DataFrame, text: str = "new_text", order: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """One duration per audio file from its word-level tags: the first row in ``order`` wins,
    without an order the smallest duration does."""
    duration = marker_duration(F.col(text))
    chosen = F.min(duration) if order is None else F.min_by(duration, order)
    return words.groupBy(*by, "audio_filename").agg(chosen.alias("duration"))


def attach_durations(
    segments: DataFrame, durations: DataFrame, key: Sequence[str] = ("audio_filename",)
) -> DataFrame:
    """Left join on the file name; a missing duration becomes 0.0."""
    joined = segments.join(durations, list(key), "left")
    return joined.withColumn("duration", F.coalesce("duration", F.lit(0.0)))


def having_audio(df: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    return df.join(inventory.select(key), key, "left_semi")


def missing_audio(df: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    return df.join(inventory.select(key), key, "left_anti")


def spot_check(
    df: DataFrame, inventory: DataFrame, key: str, n: int = 1000, seed: int = 42
) -> DataFrame:
    """Look for the audio of n sampled rows: one row per sampled key and whether it was found."""
    sample = seeded_sample(df.select(key), n, [key], seed=seed)
    found = inventory.select(key).distinct().withColumn("found", F.lit(True))
    return sample.join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the finished ones."""
    return df.join(done.select(key), key, "left_anti")


def not_yet_written(df: DataFrame, earlier: DataFrame, text: str = "text") -> DataFrame:
    """Sentences whose trimmed lower-case text is in no earlier batch; only digests are compared."""
    keys = earlier.select(text_digest(F.col(text)).alias(FOLD_KEY))
    return df.withColumn(FOLD_KEY, text_digest(F.col(text))).join(keys, FOLD_KEY, "left_anti").drop(FOLD_KEY)


def enrich(df: DataFrame, registry: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns of a registry for every row; unknown keys keep nulls."""
    return df.join(registry.select(key, *columns), key, "left")


def concatenate(parts: Sequence[DataFrame | None]) -> DataFrame:
    """All rows of the inputs that exist, schemas aligned by name."""
    present = [p for p in parts if p is not None]
    whole = present[0]
    for part in present[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole
