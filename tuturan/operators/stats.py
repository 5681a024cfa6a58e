"""Corpus statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tuturan.functions.repetition import detect_repetition

SECONDS_PER_HOUR = 3600.0


def corpus_statistics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, durations, hours and mean text length, over all rows or per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.coalesce(F.sum("duration"), F.lit(0.0)).alias("total_duration"),
        F.coalesce(F.sum("duration") / SECONDS_PER_HOUR, F.lit(0.0)).alias("hours"),
        F.avg("duration").alias("avg_duration"),
        F.min("duration").alias("min_duration"),
        F.max("duration").alias("max_duration"),
        F.avg(F.length("text")).alias("avg_chars"),
    )


def with_share(counts: DataFrame, n: str = "samples", name: str = "share") -> DataFrame:
    """Percentage of the total, over an aggregated table (one row per group)."""
    total = F.sum(n).over(Window.partitionBy(F.lit(0)))
    return counts.withColumn(name, F.col(n) * 100.0 / total)


def statistics_with_share(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Group statistics and each group's share of all rows."""
    return with_share(corpus_statistics(df, by))


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    """Rows per group, largest first, ties in key order."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by)


def length_distribution(df: DataFrame, by: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Mean, exact median, range and population deviation of the text length.

    Lengths are counted first, so the exact median works on few distinct values.
    """
    size = F.length(text)
    counted = df.groupBy(*by, size.alias("_len")).agg(F.count(F.lit(1)).alias("_n"))
    n, length = F.col("_n"), F.col("_len")
    mean = F.sum(length * n) / F.sum(n)
    second = F.sum(length.cast("double") * length * n) / F.sum(n)
    return counted.groupBy(*by).agg(
        F.sum("_n").alias("samples"),
        mean.alias("mean_chars"),
        F.percentile("_len", F.lit(0.5), F.col("_n")).alias("median_chars"),
        F.min("_len").cast("bigint").alias("min_chars"),
        F.max("_len").cast("bigint").alias("max_chars"),
        F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))).alias("std_chars"),
    )


def success_rate(df: DataFrame, error: str = "error") -> DataFrame:
    """Valid rows of all rows."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(error).isNull()).alias("valid"),
        (F.count_if(F.col(error).isNull()) * 100.0 / F.count(F.lit(1))).alias("success_percent"),
    )


def skip_report(df: DataFrame, error: str = "error", written: DataFrame | None = None) -> DataFrame:
    """Rows by reason, valid ones with a null reason, and the totals beside each: ``reason``, ``n``,
    ``percent``, ``total``, ``valid`` and ``success_percent``, from one grouping.

    With ``written``, the error output as it was read back with the same column and ``file``,
    ``n_written`` rows in ``files`` files tell whether every skipped row can be found there.
    """
    counts = df.groupBy(F.col(error).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))  # one row for each reason
    total = F.sum("n").over(every)
    valid = F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))).over(every), F.lit(0))
    report = counts.withColumns({"total": total, "valid": valid}).withColumns(
        {
            "percent": F.col("n") * 100.0 / F.col("total"),
            "success_percent": F.col("valid") * 100.0 / F.col("total"),
        }
    )
    columns = ["reason", "n", "percent", "total", "valid", "success_percent"]
    if written is None:
        return report.select(*columns)
    # files first: a reason may lie in very many
    by_file = written.groupBy(F.col(error).alias("reason"), "file").agg(F.count(F.lit(1)).alias("n"))
    found = by_file.groupBy("reason").agg(F.sum("n").alias("n_written"), F.count(F.lit(1)).alias("files"))
    none = F.lit(0).cast("bigint")
    return report.join(found, "reason", "left").select(
        *columns, F.coalesce("n_written", none).alias("n_written"), F.coalesce("files", none).alias("files")
    )


def repetition_rate(df: DataFrame, by: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Texts, looping texts and their percentage, over all rows or per group."""
    flagged = df.select(*by, detect_repetition(F.col(text))["flagged"].alias("flagged"))
    return flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("flagged").alias("flagged"),
        (F.avg(F.col("flagged").cast("int")) * 100).alias("rate_percent"),
    )


def estimated_hours(registry: DataFrame) -> DataFrame:
    """Hours per language, unknown ones as zero."""
    return registry.groupBy("language").agg(
        F.sum(F.coalesce("estimated_hours", F.lit(0.0))).alias("hours")
    )


def scalar_summary(log: DataFrame) -> DataFrame:
    """Per tag: points, first and last step, latest value, and the last step of the whole log."""
    per_tag = log.groupBy("tag").agg(
        F.count(F.lit(1)).alias("points"),
        F.min("step").alias("first_step"),
        F.max("step").alias("last_step"),
        F.max_by("value", "step").alias("latest_value"),
    )
    return per_tag.withColumn("max_step", log.agg(F.max("step")).scalar())


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and whether they agree; equal keys meet before the second count."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("total"),
            F.count(key).alias("distinct_keys"),
            (F.coalesce(F.max("_n"), F.lit(1)) == 1).alias("is_unique"),
        )
    )


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """The input itself; an error when a key occurs twice."""
    doubled = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if doubled:
        raise ValueError(f"{key} is not unique, for example {doubled[0][0]!r}")
    return df


def latest_by_number(df: DataFrame, name: Column, by: Sequence[str] = ()) -> DataFrame:
    """The artefact with the largest number after ``-`` or ``=`` in its name."""
    digits = F.regexp_extract(name, r"[-=](\d+)", 1)
    number = F.coalesce(digits.try_cast("bigint"), F.lit(0))
    return df.groupBy(*by).agg(
        F.max_by(name, F.struct(number, name)).alias("latest"), F.max(number).alias("number")
    )
