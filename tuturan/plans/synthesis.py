"""Synthetic text → manifests: generate against earlier batches, validate, split, tag, merge."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tuturan.functions.language import detect_language, tag_text
from tuturan.operators.filters import duration_between, validate_samples
from tuturan.operators.generate import (
    PERSON_FIELDS,
    generate_sentences,
    generate_until,
    quota_plan,
    sentences_by_share,
)
from tuturan.operators.ranks import stratified_split
from tuturan.operators.stats import with_share
from tuturan.session import store
from tuturan.sources.readers import read_manifest
from tuturan.sources.writers import write_manifest, write_per_speaker

Shares = Sequence[tuple[str, float]]

SENTENCES_PER_TASK = 10_000


def next_batch(
    persons: DataFrame,
    templates: Sequence[str],
    target: int,
    per_person: int,
    earlier: DataFrame | None = None,
    seed: int = 42,
    key: str = "name",
    allow_short: bool = False,
) -> DataFrame:
    """A batch of new sentences, none of which an earlier batch holds.

    ``per_person`` is the least number of samples in a round. Persons that are told apart by nothing
    a sentence takes from them count as one, as they would say the same.
    """
    told = {c.lower() for c in (key, *PERSON_FIELDS)}
    persons = persons.select(*[c for c in persons.columns if c.lower() in told]).distinct()
    keys = persons.count()

    def make(first: int, samples: int) -> DataFrame:
        parts = max(1, -(-keys * samples // SENTENCES_PER_TASK))
        return generate_sentences(persons, templates, samples, seed=seed, key=key, first_round=first, parts=parts)

    return generate_until(make, target, keys, earlier, seed=seed, per_key=per_person, allow_short=allow_short)


def synthetic_manifest(
    records: DataFrame, base: str, low: float = 0.1, high: float = 30.0, ratio: float = 0.9, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Split manifest of the valid records, and the rejected records with their reason."""
    checked = validate_samples(records, base)
    good = duration_between(checked.where("error IS NULL").drop("error"), low, high)
    return (
        stratified_split(good, [], ["audio_filepath"], ratio, seed),
        checked.where("error IS NOT NULL"),
    )


def tag_manifest(manifest: DataFrame, language: str = "auto", add_field: bool = True) -> DataFrame:
    """Language tag in front of the text, detected per row unless one is given."""
    lang = detect_language(F.col("text")) if language == "auto" else F.lit(language)
    tagged = manifest.withColumn("_lang", lang)
    out = tagged.withColumn("text", tag_text(F.col("text"), F.col("_lang")))
    return out.withColumnRenamed("_lang", "lang") if add_field else out.drop("_lang")


def generation_run(
    speakers: DataFrame,
    output: str,
    total: int,
    languages: Shares,
    topics: Shares,
    sentence_types: Sequence[str],
    templates: dict[str, Sequence[str]],
    values: dict[str, dict[str, Sequence[str]]],
    make: Callable[[DataFrame], DataFrame] | None = None,
    speaker: str = "speaker_id",
    seed: int = 42,
) -> DataFrame:
    """A whole run: quota plan → a generator, or templates where there is none → files.

    ``make`` turns the plan into sentences (text, language, topic, sentence_type, speaker); what it
    leaves missing of a speaker's share of a language, the first numbers of the templates fill.
    ``output`` gets the ``plan``, ``sentences`` in a folder for each speaker (read as a whole they are
    the combined file) and ``statistics``: planned, generated and template sentences by speaker and
    language, returned as written.
    """
    spark = speakers.sparkSession
    plan = quota_plan(speakers, F.lit(total), languages, topics, sentence_types, speaker)
    plan.write.json(f"{output}/plan")
    filled = sentences_by_share(speakers, total, languages, templates, values, speaker, seed)
    wanted = filled.groupBy(speaker, "language").agg(F.count(F.lit(1)).alias("planned"))
    made = None
    if make is not None:
        told = make(spark.read.schema(plan.schema).json(f"{output}/plan"))
        words = F.size(F.split(F.trim("text"), r"\s+")).cast("bigint")
        made = store(told.withColumn("word_count", words).withColumn("sample", F.lit(0)), "made")
        have = made.groupBy(speaker, "language").agg(F.count(F.lit(1)).alias("_have"))
        missing = filled.join(have, [speaker, "language"], "left")
        filled = missing.where(F.col("sample") > F.coalesce("_have", F.lit(0))).drop("_have")
    own = filled.withColumn("origin", F.lit("template"))
    whole = own if made is None else made.withColumn("origin", F.lit("generator")).unionByName(own)
    columns = ["text", "language", "topic", "sentence_type", "word_count", speaker, "origin"]
    write_per_speaker(whole.select(*columns), f"{output}/sentences", speaker)
    kind = speakers.schema[speaker].dataType.simpleString()
    schema = f"text string, language string, topic string, sentence_type string, word_count bigint, origin string, {speaker} {kind}"
    written = spark.read.schema(schema).json(f"{output}/sentences")
    counts = written.groupBy(speaker, "language").agg(
        F.count_if(F.col("origin") == "generator").alias("generated"),
        F.count_if(F.col("origin") == "template").alias("from_templates"),
        F.sum("word_count").alias("words"),
    )
    statistics = wanted.join(counts, [speaker, "language"], "left")
    statistics.write.json(f"{output}/statistics")
    return spark.read.schema(statistics.schema).json(f"{output}/statistics")


def tagging_run(
    spark: SparkSession,
    manifests: str | Sequence[str],
    output: str,
    language: str = "auto",
    add_field: bool = True,
) -> DataFrame:
    """A whole run over manifests: language tags in front of the texts, and counts by language.

    ``output`` gets the tagged ``manifest`` and ``counts`` (rows and their percentage), returned as
    written.
    """
    tagged = store(tag_manifest(read_manifest(spark, manifests), language), "tagged")
    write_manifest(tagged if add_field else tagged.drop("lang"), f"{output}/manifest")
    counts = with_share(tagged.groupBy("lang").agg(F.count(F.lit(1)).alias("samples")))
    counts.write.json(f"{output}/counts")
    return spark.read.schema(counts.schema).json(f"{output}/counts")
