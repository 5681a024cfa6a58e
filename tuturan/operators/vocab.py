"""Character and word statistics, vocabularies and dictionary lookup."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tuturan.functions.arrow import replaced_by_part
from tuturan.functions.expr import words_of
from tuturan.functions.language import dictionary_tokens, vocabulary_words
from tuturan.functions.text import char_class
from tuturan.operators.lookup import in_parts, is_known, looked_up, small_table
from tuturan.session import store

# The supplementary ideographs are meant as a block of five-digit code points; a four-digit reading
# of the same values would count dashes, quotes and symbols.
# --- fixed values: script ranges for vocabulary extraction --------------------------------------------
VOCABULARY_SCRIPTS = {
    "cjk": [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0xF900, 0xFAFF)],
    "hangul": [(0xAC00, 0xD7AF), (0x1100, 0x11FF)],
    "hiragana": [(0x3040, 0x309F)],
    "katakana": [(0x30A0, 0x30FF)],
    "thai": [(0x0E00, 0x0E7F)],
    "arabic": [(0x0600, 0x06FF)],
    "devanagari": [(0x0900, 0x097F)],
    "tamil": [(0x0B80, 0x0BFF)],
    "latin_extended": [(0x0100, 0x017F), (0x0180, 0x024F), (0x1E00, 0x1EFF)],
}
ANY_NON_ASCII = r"[\P{C}&&[^\x00-\x7F]]"
SUPPORTED_COVERAGE = 0.8
SUPPORTED_UNKNOWN = 0.2


def characters(col: Column, scripts: Sequence[str] | None = None) -> Column:
    """Characters of the named scripts, or all visible non-ASCII ones, as an array."""
    pattern = (
        char_class([r for s in scripts for r in VOCABULARY_SCRIPTS[s]]) if scripts else ANY_NON_ASCII
    )
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def char_frequency(
    df: DataFrame, scripts: Sequence[str] | None = None, by: Sequence[str] = (), text: str = "text"
) -> DataFrame:
    """Occurrences per character."""
    return (
        df.select(*by, F.explode(characters(F.col(text), scripts)).alias("token"))
        .groupBy(*by, "token")
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def word_frequency(df: DataFrame, min_freq: int = 1, text: str = "text") -> DataFrame:
    """Occurrences per lower-cased word."""
    counted = (
        df.select(F.explode(vocabulary_words(F.col(text))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("freq"))
    )
    return counted.where(F.col("freq") >= min_freq)


def most_frequent(freq: DataFrame, k: int, token: str = "token") -> DataFrame:
    """The k most frequent tokens, ties in code point order."""
    return freq.orderBy(F.desc("freq"), token).limit(k)


def combined_vocabulary(freqs: Sequence[DataFrame], caps: Sequence[int | None]) -> DataFrame:
    """Tokens kept by any input (each within its cap), ranked by the frequency over all inputs.

    Every input is counted once, with its number.
    """
    numbered = [f.select("token", "freq", F.lit(i).alias("_input")) for i, f in enumerate(freqs)]
    every = store(reduce(DataFrame.unionByName, numbered), "frequencies")
    open_inputs = [i for i, c in enumerate(caps) if c is None]
    kept = every.where(F.col("_input").isin(open_inputs)).select("token")
    for i, c in enumerate(caps):
        if c is not None:
            kept = kept.unionByName(most_frequent(every.where(F.col("_input") == i), c).select("token"))
    totals = every.groupBy("token").agg(F.sum("freq").alias("freq"))
    return totals.join(kept.distinct(), "token", "left_semi")


def new_tokens(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates that the vocabulary does not hold yet."""
    return candidates.join(existing.select("token"), "token", "left_anti")


def map_vocabulary_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old id and new id of every token both vocabularies hold."""
    return old.select("token", F.col("id").alias("old_id")).join(
        new.select("token", F.col("id").alias("new_id")), "token"
    )


def vocabulary_coverage(
    df: DataFrame, vocabulary: DataFrame, key: str, language: str, unit: str = "words", text: str = "text"
) -> DataFrame:
    """Per language: mean sentence coverage, share of unknown tokens, supported or not.

    A vocabulary of proven size is looked up inside each row, so only two numbers a sentence are
    shuffled; a larger one is joined with the tokens. A key that several rows share is one sentence.
    """
    tokens = words_of(F.col(text)) if unit == "words" else F.split(F.col(text), "")
    entries = vocabulary.where(F.col("token").isNotNull()).select(F.col("token").alias("word")).distinct()
    known = store(entries.withColumn("value", F.lit("")), "vocabulary")
    asked = df.select(F.explode(tokens).alias("word"))
    table = small_table(known, asked)
    if table is None:
        exploded = df.select(key, language, F.explode_outer(tokens).alias("_token"))
        counted = exploded.withColumn("_n", F.col("_token").isNotNull().cast("bigint"))
        looked = counted.join(known, F.col("_token") == F.col("word"), "left")
        unknown = F.when(F.col("word").isNull(), F.col("_n")).otherwise(0)
        counts = looked.select(key, language, "_n", unknown.alias("_unknown"))
    else:
        held, buckets = table
        in_row = df.select(key, language, tokens.alias("_tokens")).withColumn("_table", held)
        missing = F.filter("_tokens", lambda t: ~is_known(F.col("_table"), buckets, t))
        counts = in_row.select(
            key,
            language,
            F.coalesce(F.size("_tokens"), F.lit(0)).cast("bigint").alias("_n"),
            F.coalesce(F.size(missing), F.lit(0)).cast("bigint").alias("_unknown"),
        )
    per_sentence = counts.groupBy(key, language).agg(
        F.sum("_n").alias("_total"), F.sum("_unknown").alias("_unknown")
    )
    known_part = (F.col("_total") - F.col("_unknown")) / F.col("_total")
    covered = F.when(F.col("_total") > 0, known_part).otherwise(0.0)
    summary = per_sentence.groupBy(language).agg(
        F.count(F.lit(1)).alias("sentences"),
        F.avg(covered).alias("avg_coverage"),
        F.sum("_total").alias("total_tokens"),
        F.sum("_unknown").alias("total_unknown"),
        F.when(F.sum("_total") > 0, F.sum("_unknown") / F.sum("_total"))
        .otherwise(1.0)
        .alias("unknown_ratio"),
    )
    supported = (F.col("avg_coverage") >= SUPPORTED_COVERAGE) & (F.col("unknown_ratio") < SUPPORTED_UNKNOWN)
    return summary.withColumn("supported", supported)


def to_phonemes(
    df: DataFrame, dictionary: DataFrame, text: str = "text", name: str = "phonemes"
) -> DataFrame:
    """Add the text with dictionary words replaced by their phonemes; everything else stays.

    A dictionary of proven size is looked up inside each row, and rows stay where they are. For a
    larger one rows are written in parts of like size; each part gets the values of its own distinct
    tokens, and a task holds those of one part while its rows pass. So a token is shuffled once a part,
    however often it occurs, and a text once.
    """
    best = dictionary.groupBy(F.lower("word").alias("word")).agg(F.max("phonemes").alias("value"))
    entries = store(best.where("word IS NOT NULL AND value IS NOT NULL"), "dictionary", tidy=True)
    table = small_table(entries, None)
    kept = [c for c in df.columns if c != name]
    if table is not None:
        held, buckets = table
        in_row = df.select(*map(_quoted, kept), dictionary_tokens(F.col(text)).alias("_tokens")).withColumn("_table", held)
        spoken = F.transform(
            "_tokens", lambda t: F.coalesce(looked_up(F.col("_table"), buckets, F.lower(t)), t)
        )
        return in_row.withColumn(name, F.coalesce(F.array_join(spoken, ""), F.lit(""))).drop("_tokens", "_table")
    rows, part, parts = in_parts(df, text)
    of_part = rows.select(part.alias("_part"), F.explode(F.array_distinct(dictionary_tokens(F.col(text)))).alias("_token"))
    found = of_part.distinct().join(entries, F.lower("_token") == F.col("word"))
    used = store(found.select("_part", "_token", "value"), "used", tidy=True)
    whole = rows.select(part.alias("_part"), F.struct(*map(_quoted, df.columns)).alias("_own"))
    beside = used.withColumn("_own", F.lit(None).cast(whole.schema["_own"].dataType))
    met = (
        beside.unionByName(whole, allowMissingColumns=True)
        .repartitionById(parts, "_part")
        .sortWithinPartitions("_part", F.col("_own").isNotNull())
    )
    tokens = dictionary_tokens(F.col(f"_own.{text}"))
    spoken = replaced_by_part(F.col("_part"), F.col("_token"), F.col("value"), tokens)
    done = met.withColumn("_spoken", spoken).where(F.col("_own").isNotNull())
    return done.select(*(F.col("_own").getField(c).alias(c) for c in kept), F.col("_spoken").alias(name))


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")
