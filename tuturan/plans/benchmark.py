"""Benchmarks: test sets from tables of any column names, and hypotheses scored against them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tuturan.functions.expr import is_blank, strip
from tuturan.operators.filters import file_number, first_present
from tuturan.operators.ranks import number_rows
from tuturan.operators.stats import skip_report
from tuturan.operators.wer import (
    corpus_wer,
    normalize_pair,
    pair_with_reference,
    score_utterances,
    wer_matrix,
)
from tuturan.session import store
from tuturan.sources.writers import write_benchmark, write_results, write_summary

# --- fixed values: names under which tables keep text and audio, first match wins -----------------------
TEXT_COLUMNS = ["TEXT", "text", "Text", "transcript", "transcription", "sentence"]
AUDIO_COLUMNS = ["WAV", "wav", "audio", "Audio", "speech"]
SHORTEST_SECONDS = 0.1
ID_DIGITS = 6

TOTALS = "model string, dataset string, overall_wer double, num_samples bigint"

@dataclass(frozen=True)
class BenchmarkOptions:
    """``keep_failed``: a reference without a hypothesis counts as deletions.
    ``normalize_reference``: both sides go through the normaliser, else only the hypothesis."""

    keep_failed: bool = True
    normalize_reference: bool = True


def score_benchmark(
    hypotheses: DataFrame, references: DataFrame, options: BenchmarkOptions = BenchmarkOptions()
) -> DataFrame:
    """Scored utterances of (model, dataset, utterance_id, hypothesis) against
    (dataset, utterance_id, reference, language)."""
    key = ["dataset", "utterance_id"]
    if options.keep_failed:
        runs = store(hypotheses.groupBy("dataset").agg(F.collect_set("model").alias("_models")), "runs")
        references = references.join(runs, "dataset").withColumn("model", F.explode("_models")).drop("_models")
        key = ["model", *key]
    paired = pair_with_reference(hypotheses, references, key, options.keep_failed)
    normal = normalize_pair(paired, F.col("language"), options.normalize_reference)
    return score_utterances(normal)


def summarize(scored: DataFrame, datasets: list[str]) -> tuple[DataFrame, DataFrame]:
    """Long WER table and the model × dataset matrix."""
    long = corpus_wer(scored, ["model", "dataset"])
    return long, wer_matrix(long, datasets)


def run_benchmark(
    hypotheses: DataFrame,
    references: DataFrame,
    output: str,
    datasets: Sequence[str],
    options: BenchmarkOptions = BenchmarkOptions(),
) -> DataFrame:
    """A whole run: score, then ``utterances`` by model and dataset, ``totals`` and the ``summary`` table.

    The summary is made of the totals as they were written, so the outputs agree. Returns the totals.
    """
    scored = store(score_benchmark(hypotheses, references, options), "scored")
    write_results(scored, output)
    totals = scored.sparkSession.read.schema(TOTALS).json(f"{output}/totals")
    write_summary(wer_matrix(totals.withColumnRenamed("overall_wer", "wer"), list(datasets)), f"{output}/summary")
    return totals


def prepare_test_set(
    rows: DataFrame,
    output: str,
    name: str,
    order: str,
    duration: str = "duration",
    shortest: float = SHORTEST_SECONDS,
) -> DataFrame:
    """A test set from a table that keeps text and audio under one of several names.

    Rows are numbered in the order of a column before any is left out; ids and files carry that
    number. ``output`` gets the ``test`` table, ``skipped`` rows with their reason, and the ``report``
    of rows by reason with the success rate, which is returned as written. A null reason is success.
    """
    text = F.col(f"`{first_present(rows.columns, TEXT_COLUMNS)}`").cast("string")
    audio = F.col(f"`{first_present(rows.columns, AUDIO_COLUMNS)}`").cast("string")
    error = (
        F.when(is_blank(text), "no text")
        .when(is_blank(audio), "no audio")
        .when(F.col(duration).isNull(), "unreadable audio")
        .when(F.col(duration) < shortest, "too short")
    )
    numbered = number_rows(rows, order, name="_number")
    utterance = file_number(F.lit(f"{name}_"), F.col("_number") - 1, ID_DIGITS, "")
    checked = store(
        numbered.select(
            utterance.alias("utterance_id"),
            F.concat(F.lit("audio/"), utterance, F.lit(".wav")).alias("path"),
            strip(text).alias("sentence"),
            F.col(duration).alias("duration"),
            audio.alias("source_audio"),
            error.alias("error"),
        ),
        "checked",
    )
    write_benchmark(checked.where("error IS NULL"), f"{output}/test")
    checked.where("error IS NOT NULL").write.json(f"{output}/skipped")
    report = skip_report(checked)
    report.write.json(f"{output}/report")
    return checked.sparkSession.read.schema(report.schema).json(f"{output}/report")
