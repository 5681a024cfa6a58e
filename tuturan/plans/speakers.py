"""Speaker corpora for synthesis: metadata of several speakers → split speaker manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tuturan.functions.expr import strip
from tuturan.operators.filters import (
    MAX_TEXT_CHARS,
    TTS_DURATION,
    XTTS_DURATION,
    XTTS_TEXT,
    first_filled,
    speaker_id,
    text_problems,
)
from tuturan.operators.ranks import seeded_sample, stratified_split
from tuturan.session import store
from tuturan.sources.writers import write_pipe_metadata


def prepare_speakers(
    metadata: DataFrame,
    ids: dict[str, int],
    audio: DataFrame | None = None,
    speakers: Sequence[str] | None = None,
    max_total: int | None = None,
    max_chars: int = MAX_TEXT_CHARS,
    low: float = TTS_DURATION[0],
    high: float = TTS_DURATION[1],
    ratio: float = 0.95,
    seed: int = 42,
    unique_key: bool = False,
) -> DataFrame:
    """Rows of (speaker, original, normalized, audio_filename, duration) with text, in range and
    with audio, numbered by speaker and split within each speaker.

    ``max_total`` gives every chosen speaker the same share of it.
    """
    rows = metadata if speakers is None else metadata.where(F.col("speaker").isin(*speakers))
    if max_total is not None:
        groups = len(speakers) if speakers is not None else rows.select("speaker").distinct().count()
        rows = seeded_sample(
            rows, max_total // groups, ["audio_filename"], ["speaker"], seed, unique_key
        )
    text = strip(first_filled(metadata, ["normalized", "original"]))
    kept = rows.withColumn("text", text).where(
        (F.col("text") != "")
        & (F.length("text") <= max_chars)
        & (F.col("audio_filename") != "")
        & F.col("duration").between(low, high)
    )
    if audio is not None:
        kept = kept.join(audio.select("audio_filename"), "audio_filename", "left_semi")
    numbered = kept.select(
        "audio_filename",
        "text",
        F.round("duration", 3).alias("duration"),
        "speaker",
        speaker_id(F.col("speaker"), ids).alias("speaker_id"),
    )
    return stratified_split(numbered, ["speaker"], ["audio_filename"], ratio, seed, unique_key)


def build_speaker_corpus(
    metadata: DataFrame,
    output: str,
    ratio: float = 0.9,
    seed: int = 42,
    text_limits: tuple[int, int] = XTTS_TEXT,
    duration: tuple[float, float] = XTTS_DURATION,
    unique_key: bool = False,
) -> DataFrame:
    """Rows of (file, text, speaker, duration) → checked, split by speaker and written.

    ``train`` and ``eval`` hold ``file|text|speaker`` lines, ``rejected`` the other rows with their
    reasons. Returns rows and seconds by speaker and split, counted over the written split.
    """
    problems = text_problems(F.col("text"), *text_limits)
    unfit = F.when(~F.coalesce(F.col("duration").between(*duration), F.lit(False)), "Duration out of range")
    reasons = F.array_compact(F.array_append(F.coalesce(problems, F.array(F.lit("No text"))), unfit))
    checked = store(metadata.withColumn("reasons", reasons), "checked")
    good = checked.where(F.size("reasons") == 0).drop("reasons")
    split = store(stratified_split(good, ["speaker"], ["file"], ratio, seed, unique_key), "speakers")
    for side, part in (("train", "train"), ("val", "eval")):
        write_pipe_metadata(split.where(F.col("split") == side), f"{output}/{part}", ["file", "text", "speaker"])
    checked.where(F.size("reasons") > 0).write.json(f"{output}/rejected")
    return split.groupBy("speaker", "split").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("duration").alias("seconds")
    )
