"""Row filters, validation with reasons, attrition counts and path projections."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tuturan.functions.expr import is_blank, strip, words_of

# --- fixed values: duration limits in seconds, text limits in characters -------------------------------
ASR_DURATION = (0.1, 30.0)
TTS_DURATION = (0.5, 15.0)
XTTS_DURATION = (3.0, 15.0)
XTTS_TEXT = (20, 200)
MAX_TEXT_CHARS = 1500


def duration_between(
    df: DataFrame, low: float = ASR_DURATION[0], high: float = ASR_DURATION[1], col: str = "duration"
) -> DataFrame:
    return df.where(F.col(col).between(low, high))


def duration_between_if_known(
    df: DataFrame, low: float = ASR_DURATION[0], high: float = ASR_DURATION[1], col: str = "duration"
) -> DataFrame:
    """The duration filter, skipped as a whole when no row has a duration above zero."""
    longest = df.agg(F.max(col)).scalar()
    return df.where(F.coalesce(longest <= 0, F.lit(True)) | F.col(col).between(low, high))


def keep_languages(df: DataFrame, languages: Sequence[str], col: str = "language") -> DataFrame:
    return df.where(F.col(col).isin(*languages))


def with_text(
    df: DataFrame, text: Column, keep: Callable[[Column], Column], name: str = "text"
) -> DataFrame:
    """Compute a text once and keep the rows that pass ``keep``.

    The test sits in a generator: as a predicate Spark would push it below the projection and
    compute the text once more for the filter.
    """
    passed = F.filter(F.array(text), keep)
    return df.select("*", F.explode(passed).alias("_text")).withColumn(name, F.col("_text")).drop("_text")


def language_counts(
    df: DataFrame, languages: Sequence[str], col: str = "language"
) -> DataFrame:
    """Rows kept and removed per language by the inclusion list."""
    kept = F.coalesce(F.col(col).isin(*languages), F.lit(False))
    return df.groupBy(col).agg(
        F.count_if(kept).alias("kept"), F.count_if(~kept).alias("removed")
    )


def text_problems(
    text: Column, low: int = XTTS_TEXT[0], high: int = XTTS_TEXT[1]
) -> Column:
    """Reasons why a text is not usable for synthesis training, in a fixed order."""
    size = F.length(text)
    return F.array_compact(
        F.array(
            F.when(
                size < low, F.concat(F.lit("Text too short: "), size.cast("string"), F.lit(f" < {low}"))
            ),
            F.when(
                size > high, F.concat(F.lit("Text too long: "), size.cast("string"), F.lit(f" > {high}"))
            ),
            F.when(F.contains(text, F.lit("|")), F.lit("Text contains pipe character")),
        )
    )


def long_enough(text: Column, min_words: int = 0, min_chars: int = 0) -> Column:
    return (F.size(words_of(text)) >= min_words) & (F.length(text) >= min_chars)


def first_present(columns: Sequence[str], candidates: Sequence[str]) -> str:
    """Name of the first candidate column that exists."""
    for name in candidates:
        if name in columns:
            return name
    raise ValueError(f"none of {list(candidates)} among {list(columns)}")


def first_filled(df: DataFrame, candidates: Sequence[str]) -> Column:
    """First non-empty value of the candidate columns that exist."""
    found = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in candidates if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def validate_samples(df: DataFrame, base: str, require_duration: bool = True) -> DataFrame:
    """Flexible records → manifest columns plus ``error`` (null when the row is valid)."""
    path = first_filled(df, ["audio_path", "audio_filepath"])
    raw = first_filled(df, ["text", "transcription", "reference"])
    seconds = first_filled(df, ["duration", "audio_duration"]).try_cast("double")
    error = (
        F.when(path.isNull(), "missing audio path")
        .when(raw.isNull(), "missing transcription")
        .when(is_blank(raw), "empty transcription")
        .when(seconds.isNull() | (F.lit(require_duration) & (seconds <= 0)), "bad duration")
    )
    return df.select(
        absolute_path(path, base).alias("audio_filepath"),
        strip(raw).alias("text"),
        seconds.alias("duration"),
        error.alias("error"),
    )


@dataclass(frozen=True)
class Stage:
    """One step of the funnel: its name and the condition a row must meet to go on."""

    name: str
    keep: Column


def drop_reason(stages: Sequence[Stage]) -> Column:
    """Name of the first stage a row fails, null for a row that passes them all."""
    reason = F.lit(None).cast("string")
    for stage in reversed(stages):
        failed = ~F.coalesce(stage.keep, F.lit(False))
        reason = F.when(failed, stage.name).otherwise(reason)
    return reason


def attrition(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Rows dropped at and remaining after each stage, from one pass over the data."""
    order = F.array(*[F.lit(s.name) for s in stages])
    counts = df.groupBy(F.coalesce(drop_reason(stages), F.lit("kept")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )
    by_name = counts.agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("m"))
    rows = by_name.select("m", F.posexplode(order).alias("step", "stage"))
    later = F.array_append(F.slice(order, F.col("step") + 2, F.size(order)), F.lit("kept"))
    count_of = lambda k: F.coalesce(F.try_element_at(F.col("m"), k), F.lit(0))
    return rows.select(
        (F.col("step") + 1).cast("bigint").alias("step"),
        "stage",
        count_of(F.col("stage")).cast("bigint").alias("dropped"),
        F.aggregate(later, F.lit(0).cast("bigint"), lambda a, k: a + count_of(k)).alias("remaining"),
    )


def length_budget(
    df: DataFrame, max_duration: float = TTS_DURATION[1], max_chars: int = MAX_TEXT_CHARS
) -> DataFrame:
    """Rows within duration and text budget (training-time filter)."""
    return df.where((F.coalesce(F.col("duration"), F.lit(0.0)) <= max_duration) & (F.length("text") <= max_chars))


# ------------------------------------------------------------------------------------------------ paths
def absolute_path(path: Column, base: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(
        F.concat(F.lit(base.rstrip("/") + "/"), path)
    )


def rebase_path(path: Column, old: str, new: str) -> Column:
    """Replace the prefix ``old``; other paths stay."""
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def id_category(uid: Column) -> Column:
    """Second part of an underscore-separated id, ``OTHER`` when there is only one."""
    return F.coalesce(F.get(F.split(uid, "_"), 1), F.lit("OTHER"))


def speaker_id(name: Column, speakers: dict[str, int]) -> Column:
    """Number of a speaker; an unknown one gets the size of the map."""
    found = F.lit(len(speakers))
    for known, number in speakers.items():
        found = F.when(name == known, number).otherwise(found)
    return found


def file_number(prefix: Column, number: Column, width: int, suffix: str) -> Column:
    return F.concat(prefix, F.lpad(number.cast("string"), width, "0"), F.lit(suffix))
