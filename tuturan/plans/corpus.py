"""Corpus preparation: tagged or paired shards → filtered, normalised, split manifests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tuturan.functions.asr import preprocess_asr
from tuturan.functions.expr import is_blank, strip
from tuturan.functions.language import spoken_language
from tuturan.functions.numbers import normalize_numbers
from tuturan.functions.text import contains_non_latin, is_valid_text, preprocess_zh, remove_emoji
from tuturan.operators.filters import (
    Stage,
    absolute_path,
    attrition,
    drop_reason,
    duration_between_if_known,
    with_text,
)
from tuturan.operators.joins import concatenate, match_utterances, spot_check
from tuturan.operators.ranks import seeded_sample, shuffle_rows, stratified_split
from tuturan.operators.stats import corpus_statistics
from tuturan.session import store
from tuturan.sources.inventory import path_exists
from tuturan.sources.readers import pick_sources, read_audio_paths, read_paired, read_transcripts
from tuturan.sources.writers import manifest_rows, write_manifest

TRAIN_SUBSETS = ["train_phase1", "train_phase2"]
VAL_SUBSETS = ["dev_phase1", "dev_phase2"]
TEST_SUBSETS = ["test"]


@dataclass(frozen=True)
class CorpusOptions:
    """Switches of the preparation, with the usual defaults."""

    min_duration: float = 0.1
    max_duration: float = 30.0
    languages: tuple[str, ...] | None = None
    exclude_non_latin: bool = True
    preprocess: bool = True
    numbers_only: bool = False
    remove_punctuation: bool = False
    clean_for_asr: bool = False
    filter_invalid_chars: bool = False
    max_samples: int | None = None
    train_split: float = 0.95
    seed: int = 42
    key: tuple[str, ...] = ("audio_filename",)
    unique_key: bool = False
    sources: tuple[str, ...] | None = None
    spot_check: int = 0


def numbers_to_words(text: Column, language: Column) -> Column:
    """Numbers only, in the language of the row."""
    return (
        F.when(language == "ms", normalize_numbers(text, "ms"))
        .when(language == "zh", normalize_numbers(text, "zh"))
        .otherwise(normalize_numbers(text, "en"))
    )


def cheap_stages(options: CorpusOptions) -> list[Stage]:
    """Filters on the columns as they were read."""
    stages = [Stage("duration", F.col("duration").between(options.min_duration, options.max_duration))]
    if options.languages:
        stages.append(Stage("language", F.col("language").isin(*options.languages)))
    if options.exclude_non_latin:
        stages.append(Stage("script", ~contains_non_latin(F.col("text"))))
    return stages


def late_stages(options: CorpusOptions, text: Column) -> list[Stage]:
    """Filters on the prepared text."""
    stages = [Stage("empty", text != "")]
    if options.filter_invalid_chars:
        stages.append(Stage("characters", is_valid_text(text)))
    return stages


def prepared_text(options: CorpusOptions) -> Column:
    """The prepared form of ``_clean``, the text without emoji."""
    language = spoken_language(F.col("language"))
    clean = F.col("_clean")
    if options.preprocess:
        return preprocess_asr(
            clean,
            language,
            remove_punctuation=options.remove_punctuation,
            clean_for_asr=options.clean_for_asr,
        )
    return numbers_to_words(clean, language) if options.numbers_only else clean


def prepare_rows(corpus: DataFrame, options: CorpusOptions) -> DataFrame:
    """Filter, normalise and filter again."""
    early = corpus
    for stage in cheap_stages(options):
        early = early.where(stage.keep)
    early = early.withColumn("_clean", remove_emoji(F.col("text")))
    passes = lambda text: reduce(lambda a, b: a & b, [s.keep for s in late_stages(options, text)])
    return with_text(early, prepared_text(options), passes).drop("_clean")


def prepare_corpus(
    corpus: DataFrame, options: CorpusOptions = CorpusOptions(), audio: DataFrame | None = None
) -> DataFrame:
    """Sample, filter, normalise, keep rows whose audio exists, split by source.

    The prepared rows are written once: the split then reads only the columns it ranks by.
    """
    rows = corpus
    if options.max_samples:
        rows = seeded_sample(
            rows, options.max_samples, options.key, seed=options.seed, unique_key=options.unique_key
        )
    kept = prepare_rows(rows, options)
    if audio is not None:
        kept = kept.join(audio.select("audio_filename"), "audio_filename", "left_semi")
    return stratified_split(
        store(kept, "prepared"),
        ["source"],
        options.key,
        options.train_split,
        options.seed,
        options.unique_key,
    )


def corpus_attrition(
    corpus: DataFrame, options: CorpusOptions = CorpusOptions(), audio: DataFrame | None = None
) -> DataFrame:
    """How many rows each stage of the preparation drops, from one pass.

    With an inventory of audio files their absence is the last stage.
    """
    early = cheap_stages(options)
    passed = drop_reason(early).isNull()
    clean = corpus.withColumn("_clean", remove_emoji(F.col("text")))
    marked = clean.withColumn("_ready", F.when(passed, prepared_text(options)))
    stages = [*early, *late_stages(options, F.col("_ready"))]
    if audio is not None:
        there = audio.select("audio_filename").distinct().withColumn("_there", F.lit(True))
        marked = marked.join(there, "audio_filename", "left")
        stages.append(Stage("audio", F.coalesce("_there", F.lit(False))))
    return attrition(marked, stages)


def build_corpus(
    corpus: DataFrame,
    output: str,
    base: str,
    options: CorpusOptions = CorpusOptions(),
    audio: DataFrame | None = None,
) -> DataFrame:
    """A whole run: chosen sources → preparation → existence → split → manifests and statistics.

    ``output`` gets ``train`` and ``val`` manifests, ``statistics`` by split and, where asked for,
    a ``spot_check`` of sampled files. Returns the statistics as they were written.
    """
    rows = pick_sources(corpus, options.sources)
    split = store(prepare_corpus(rows, options, audio), "split")
    for side in ("train", "val"):
        write_manifest(manifest_rows(split.where(F.col("split") == side), base), f"{output}/{side}")
    corpus_statistics(split, ["split"]).write.json(f"{output}/statistics")
    if options.spot_check and audio is not None:
        found = spot_check(split, audio, "audio_filename", options.spot_check, options.seed)
        found.write.json(f"{output}/spot_check")
    return corpus.sparkSession.read.json(f"{output}/statistics")


def build_paired_corpus(
    spark: SparkSession,
    folder: str,
    output: str,
    base: str,
    options: CorpusOptions = CorpusOptions(),
    audio: DataFrame | None = None,
) -> DataFrame:
    """Paired shards → duration filter where durations are known → existence → split → manifests.

    The text is taken as the shards have it. Returns rows and hours by split, as written.
    """
    paired = read_paired(spark, folder, options.sources)
    kept = duration_between_if_known(paired, options.min_duration, options.max_duration)
    if audio is not None:
        kept = kept.join(audio.select("audio_filename"), "audio_filename", "left_semi")
    split = stratified_split(
        store(kept, "paired"), ["source"], ["audio_filename"], options.train_split, options.seed, options.unique_key
    )
    split = store(split, "split")
    for side in ("train", "val"):
        write_manifest(manifest_rows(split.where(F.col("split") == side), base), f"{output}/{side}")
    corpus_statistics(split, ["split"]).write.json(f"{output}/statistics")
    return spark.read.json(f"{output}/statistics")


def prepare_keyed_corpus(
    matched: DataFrame, low: float = 0.1, high: float = 30.0, normalize: bool = True
) -> DataFrame:
    """Matched utterances of declared subsets: filter, normalise, round the duration."""
    text = preprocess_zh(F.col("text")) if normalize else F.col("text")
    kept = matched.where(~is_blank(F.col("text")) & F.col("duration").between(low, high))
    cleaned = with_text(kept, strip(text), lambda t: t != "")
    return cleaned.withColumn("duration", F.round("duration", 4))


def route_subsets(df: DataFrame, key: Sequence[str], subset: str = "subset", seed: int = 42) -> DataFrame:
    """Split by declared subset; without any validation rows 5 % of the training rows are taken."""
    declared = (
        F.when(F.col(subset).isin(*TRAIN_SUBSETS), "train")
        .when(F.col(subset).isin(*VAL_SUBSETS), "val")
        .when(F.col(subset).isin(*TEST_SUBSETS), "test")
    )
    routed = df.withColumn("split", declared).where(F.col("split").isNotNull())
    if not routed.where("split = 'val'").isEmpty():
        return routed
    train = routed.where("split = 'train'").drop("split")
    split = stratified_split(train, [], key, 0.95, seed)
    return split.unionByName(routed.where("split <> 'train'").select(*split.columns))


def read_subsets(
    spark: SparkSession, folder: str, subsets: Sequence[str], max_samples: int | None = None, seed: int = 42
) -> DataFrame:
    """Utterances of the subsets that are there, with text and audio path; of each at most
    ``max_samples``, by a seeded sample. A subset is a folder with ``text`` and ``wav.scp``."""
    parts = []
    for subset in subsets:  # a handful, by name
        text, wav = f"{folder}/{subset}/text", f"{folder}/{subset}/wav.scp"
        if path_exists(spark, text) and path_exists(spark, wav):
            matched = match_utterances(read_transcripts(spark, text), read_audio_paths(spark, wav))
            parts.append(matched.withColumn("subset", F.lit(subset)))
    if not parts:
        raise ValueError(f"none of {list(subsets)} in {folder}")
    matched = concatenate(parts)
    if max_samples is None:
        return matched
    return seeded_sample(matched, max_samples, ["utt_id"], ["subset"], seed, unique_key=True)


def build_keyed_corpus(
    spark: SparkSession,
    folder: str,
    output: str,
    base: str,
    audio: DataFrame,
    subsets: Sequence[str] = (*TRAIN_SUBSETS, *VAL_SUBSETS, *TEST_SUBSETS),
    low: float = 0.1,
    high: float = 30.0,
    normalize: bool = True,
    max_samples: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """A whole run: chosen subsets → limit of each → existence → filter, normalise → route → manifests.

    ``audio`` has the ``path`` of every file that exists and its ``duration``, null where it cannot be
    read. ``output`` gets ``train``, ``val`` and ``test`` manifests, ``skipped`` (utterances by subset
    and reason) and ``statistics`` by split and subset, which are returned as written.
    """
    chosen = read_subsets(spark, folder, subsets, max_samples, seed)
    placed = chosen.withColumn("path", absolute_path(F.col("audio_path"), base))
    known = audio.select("path", "duration", F.lit(True).alias("_there"))
    timed = store(placed.join(known, "path", "left"), "timed")
    ready = preprocess_zh(F.col("text")) if normalize else F.col("text")
    stages = [
        Stage("missing audio", F.col("_there")),
        Stage("unreadable audio", F.col("duration").isNotNull()),
        Stage("empty text", ~is_blank(F.col("text"))),
        Stage("duration", F.col("duration").between(low, high)),
        Stage("empty after normalisation", strip(ready) != ""),
    ]
    reasons = timed.withColumn("reason", drop_reason(stages)).where("reason IS NOT NULL")
    skipped = reasons.groupBy("subset", "reason").agg(F.count(F.lit(1)).alias("n"))
    skipped.write.json(f"{output}/skipped")
    kept = prepare_keyed_corpus(timed.where("_there"), low, high, normalize)
    routed = store(route_subsets(store(kept, "kept"), ["utt_id"], seed=seed), "routed")
    for side in ("train", "val", "test"):
        own = routed.where(F.col("split") == side).select(F.col("path").alias("audio_filepath"), "text", "duration")
        write_manifest(own, f"{output}/{side}")
    statistics = corpus_statistics(routed, ["split", "subset"])
    statistics.write.json(f"{output}/statistics")
    return spark.read.schema(statistics.schema).json(f"{output}/statistics")


def merge_manifests(
    parts: Sequence[DataFrame | None], key: Sequence[str] = ("audio_filepath",), seed: int | None = None
) -> DataFrame:
    """Concatenate the manifests that exist; with a seed in shuffled order."""
    whole = concatenate(parts)
    return whole if seed is None else shuffle_rows(whole, key, seed)
