"""Records that do not fit their schema, as rows with file and reason instead of silence.

A checked read keeps every record: the fields of the good ones, and for the others the record as it
was written. ``accepted`` and ``rejected`` are the two sides of one read; ``write_checked`` writes the
rejects where they can be looked at and counts them by file and reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tuturan.session import store

RECORD, FILE, REASON = "_record", "_file", "_reason"
NOT_JSON, NOT_FITTING, BAD_ROW = "not JSON", "value of another type", "malformed row"


def checked_json(
    spark: SparkSession, path: str | Sequence[str], schema: str, whole_files: bool = False
) -> DataFrame:
    """JSON lines, or one record a file, with ``_record``, ``_file`` and ``_reason`` (null when good).

    Blank lines are no records. A record is not JSON, or a field of it has another type than the
    schema says; missing and further fields are no fault. Lines are parsed as columns: the file
    reader would look only at the fields a query asks for, and find other faults in each.
    """
    lines = spark.read.text(path, wholetext=whole_files)
    folders = [c for c in lines.columns if c != "value"]  # partition columns
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RECORD}
    parsed = lines.where(F.trim("value") != "").select(
        F.from_json("value", f"{schema}, {RECORD} string", options).alias("_fields"),
        *folders,
        F.col("_metadata.file_path").alias(FILE),
    )
    flat = parsed.select("_fields.*", *folders, FILE)
    tried = F.try_parse_json(F.col(RECORD))
    # a lone word or number is JSON for a value, not for a record
    is_record = F.coalesce(F.schema_of_variant(tried).startswith("OBJECT"), F.lit(False))
    reason = F.when(is_record, NOT_FITTING).otherwise(NOT_JSON)
    return flat.withColumn(REASON, F.when(F.col(RECORD).isNotNull(), reason))


def checked_csv(spark: SparkSession, path: str | Sequence[str], schema: str, **options) -> DataFrame:
    """CSV with a header; a row with too few or too many fields, or a value of another type, is rejected.

    The parsed rows are written once, whole, for the reason that ``checked_json`` gives.
    """
    raw = (
        spark.read.schema(f"{schema}, {RECORD} string")
        .option("header", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RECORD)
        .options(**options)
        .csv(path)
    )
    told = raw.select(
        "*", F.col("_metadata.file_path").alias(FILE), F.when(F.col(RECORD).isNotNull(), BAD_ROW).alias(REASON)
    )
    return store(told, "checked")


def accepted(checked: DataFrame) -> DataFrame:
    """The good records, with the columns of their schema."""
    return checked.where(F.col(REASON).isNull()).drop(RECORD, FILE, REASON)


def rejected(checked: DataFrame) -> DataFrame:
    """``file``, ``reason`` and ``record`` of the others."""
    bad = checked.where(F.col(REASON).isNotNull())
    return bad.select(F.col(FILE).alias("file"), F.col(REASON).alias("reason"), F.col(RECORD).alias("record"))


def reject_counts(rejects: DataFrame) -> DataFrame:
    """Rejected records by file and reason."""
    return rejects.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n"))


def write_checked(checked: DataFrame, good: str, bad: str) -> DataFrame:
    """Good records as JSON lines to one place, rejects to another; the counts of what was written."""
    accepted(checked).write.json(good)
    rejected(checked).write.json(bad)
    written = checked.sparkSession.read.schema("file string, reason string, record string").json(bad)
    return reject_counts(written)
