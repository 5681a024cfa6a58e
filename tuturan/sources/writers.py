"""Writers for manifests, benchmark tables, metadata files, dictionaries and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def manifest_rows(df: DataFrame, base: str, file: str = "audio_filename") -> DataFrame:
    """Manifest columns with absolute paths; further columns of the input follow."""
    extra = [c for c in ("speaker", "language", "lang") if c in df.columns]
    path = F.concat(F.lit(base.rstrip("/") + "/"), F.col(file))
    return df.select(path.alias("audio_filepath"), "text", "duration", *extra)


def write_manifest(df: DataFrame, path: str) -> None:
    """One JSON object per line, non-ASCII characters as they are."""
    df.write.json(path)


def benchmark_rows(df: DataFrame, decimals: int = 3) -> DataFrame:
    """Benchmark columns with the duration printed at fixed decimals."""
    printed = F.format_string(f"%.{decimals}f", F.col("duration"))
    return df.select("utterance_id", "path", "sentence", printed.alias("duration"))


def write_benchmark(df: DataFrame, path: str, decimals: int = 3) -> None:
    benchmark_rows(df, decimals).write.option("sep", "\t").option("header", "true").csv(path)


def pipe_line(*cols: Column, text: int = 1) -> Column:
    """Columns joined by ``|``; pipes inside the text become blanks."""
    parts = [F.replace(c, F.lit("|"), F.lit(" ")) if i == text else c for i, c in enumerate(cols)]
    return F.concat_ws("|", *parts)


def write_pipe_metadata(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    df.select(pipe_line(*[F.col(c) for c in columns]).alias("value")).write.text(path)


def write_with_errors(df: DataFrame, good: str, bad: str, error: str = "error") -> None:
    """Valid rows to one place, the others with their reason to another."""
    df.where(F.col(error).isNull()).drop(error).write.json(good)
    df.where(F.col(error).isNotNull()).write.json(bad)


def read_errors(spark: SparkSession, bad: str, schema: str) -> DataFrame:
    """What ``write_with_errors`` put aside, with ``error`` and ``file``, its place."""
    raw = spark.read.schema(f"{schema}, error string").json(bad)
    return raw.select("*", F.col("_metadata.file_name").alias("file"))


def dictionary_lines(df: DataFrame) -> DataFrame:
    """``WORD phonemes`` lines in word order."""
    line = F.concat(F.upper("word"), F.lit(" "), F.col("phonemes"))
    return df.orderBy("word").select(line.alias("value"))


def write_dictionary(df: DataFrame, path: str) -> None:
    dictionary_lines(df).write.text(path)


def result_totals(scored: DataFrame) -> DataFrame:
    """Overall WER and number of utterances of every model and dataset."""
    return scored.groupBy("model", "dataset").agg(
        (F.sum("errors") / F.nullif(F.sum("ref_words"), F.lit(0))).alias("overall_wer"),
        F.count(F.lit(1)).alias("num_samples"),
    )


def result_rows(scored: DataFrame) -> DataFrame:
    """Result columns of every utterance."""
    return scored.select(
        "model",
        "dataset",
        "utterance_id",
        F.col("reference").alias("groundtruth"),
        F.col("hypothesis").alias("predicted"),
        "wer",
    )


def write_summary(matrix: DataFrame, path: str) -> None:
    """The model × dataset table as CSV."""
    matrix.orderBy("model").write.option("header", "true").csv(path)


def write_results(scored: DataFrame, path: str) -> None:
    """``utterances``: result rows in a folder for each model and dataset; ``totals``: a row each."""
    _by_folder(result_rows(scored), ["model", "dataset"]).json(f"{path}/utterances")
    result_totals(scored).write.json(f"{path}/totals")


def write_per_speaker(df: DataFrame, path: str, speaker: str = "speaker_id") -> None:
    """One folder per speaker; read as a whole it is the combined file."""
    _by_folder(df, [speaker]).json(path)


def _by_folder(df: DataFrame, by: list[str]):
    """A writer with few files in each folder: rows are gathered by folder, a large one in parts.

    Rebalancing splits what is more than a partition's share, so a folder of any size has no one task.
    """
    return df.hint("rebalance", *by).write.partitionBy(*by)
