"""Word error rates: per utterance, corpus, model × dataset, and between two runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tuturan.functions.arrow import edit_operations
from tuturan.functions.scoring import char_errors, error_rate, scoring_text, word_count, word_errors
from tuturan.operators.ranks import top_per_group

ID = ["utterance_id"]


def pair_with_reference(
    hypotheses: DataFrame, references: DataFrame, key: Sequence[str] = ID, keep_failed: bool = False
) -> DataFrame:
    """Hypotheses with their references. By default only ids known on both sides count; with
    ``keep_failed`` every reference counts and a missing hypothesis is empty text."""
    if not keep_failed:
        return hypotheses.join(references, list(key))
    paired = references.join(hypotheses, list(key), "left")
    return paired.withColumn("hypothesis", F.coalesce("hypothesis", F.lit("")))


def normalize_pair(
    df: DataFrame, language: Column | str = "ms", normalize_reference: bool = True
) -> DataFrame:
    """Scoring normaliser on the hypothesis and, unless switched off, on the reference."""
    out = df.withColumn("hypothesis", scoring_text(F.col("hypothesis"), language))
    if normalize_reference:
        out = out.withColumn("reference", scoring_text(F.col("reference"), language))
    return out


def score_utterances(df: DataFrame) -> DataFrame:
    """Word errors, reference words and WER (null for an empty reference) per utterance."""
    scored = df.withColumns(
        {
            "errors": word_errors(F.col("reference"), F.col("hypothesis")),
            "ref_words": word_count(F.col("reference")),
        }
    )
    return scored.withColumn("wer", error_rate(F.col("errors"), F.col("ref_words")))


def corpus_wer(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Σ errors / Σ reference words."""
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("errors").alias("errors"),
        F.sum("ref_words").alias("ref_words"),
        error_rate(F.sum("errors"), F.sum("ref_words")).alias("wer"),
    )


def edit_breakdown(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Substitutions, insertions, deletions, hits, WER and CER per group."""
    counted = df.select(
        *by,
        edit_operations(F.col("reference"), F.col("hypothesis")).alias("ops"),
        word_count(F.col("reference")).alias("ref_words"),
        char_errors(F.col("reference"), F.col("hypothesis")).alias("char_errors"),
        F.length("reference").alias("ref_chars"),
    )
    total = lambda c: F.sum(c).cast("bigint")
    kinds = ["substitutions", "insertions", "deletions", "hits"]
    sums = counted.groupBy(*by).agg(
        *[total(F.col("ops")[k]).alias(k) for k in kinds],
        total(F.col("ref_words")).alias("ref_words"),
        total(F.col("char_errors")).alias("char_errors"),
        total(F.col("ref_chars")).alias("ref_chars"),
    )
    errors = F.col("substitutions") + F.col("insertions") + F.col("deletions")
    return sums.withColumn("wer", error_rate(errors, F.col("ref_words"))).withColumn(
        "cer", error_rate(F.col("char_errors"), F.col("ref_chars"))
    )


def wer_matrix(results: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """One row per model, one column per dataset, NaN where a cell was not run."""
    wide = results.groupBy("model").pivot("dataset", list(datasets)).agg(F.first("wer"))
    return wide.na.fill(float("nan"), list(datasets))


def best_checkpoint(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lowest WER, ties in name order."""
    return results.groupBy(*by).agg(
        F.min_by("checkpoint", F.struct("wer", "checkpoint")).alias("best_checkpoint"),
        F.min("wer").alias("wer"),
    )


def compare_runs(base: DataFrame, other: DataFrame, key: Sequence[str] = ID) -> DataFrame:
    """Both WERs per utterance, their difference and the verdict on the second run."""
    joined = base.select(*key, F.col("wer").alias("base_wer")).join(
        other.select(*key, F.col("wer").alias("other_wer")), list(key)
    )
    delta = F.col("other_wer") - F.col("base_wer")
    verdict = F.when(delta < 0, "better").when(delta > 0, "worse").otherwise("same")
    return joined.withColumn("delta", delta).withColumn("verdict", verdict)


def comparison_summary(compared: DataFrame) -> DataFrame:
    """Better, worse and same counts and the net impact."""
    better = F.count_if(F.col("verdict") == "better")
    worse = F.count_if(F.col("verdict") == "worse")
    total = F.count(F.lit(1))
    return compared.agg(
        better.alias("better"),
        worse.alias("worse"),
        F.count_if(F.col("verdict") == "same").alias("same"),
        (better - worse).alias("net"),
        ((better - worse) * 100.0 / total).alias("net_percent"),
    )


def extremes(compared: DataFrame, n: int, key: Sequence[str] = ID) -> DataFrame:
    """The n largest regressions and the n largest improvements."""
    changed = compared.where(F.col("verdict") != "same")
    return top_per_group(changed, n, ["verdict"], [F.abs("delta").desc(), *[F.col(k) for k in key]])
