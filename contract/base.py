"""Registry and the bindings from the given tables to corpus shapes, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its inventory id and, where SQL can say it, the SQL."""

    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table. One with much work per row is dealt out over parts that do not grow with it."""
    path = f"{folder}/{name}.parquet"
    rows = spark.read.parquet(path)
    if name not in DEALT_OUT:
        return rows
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0  # a listing
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, -(-size // PART_BYTES)))


# Tables with much work per row, and the bytes of their files that are one task's share.
DEALT_OUT = {"documents", "conversations", "orders", "customer", "supplier"}
PART_BYTES = 4 << 20


# Corpus rows: one per document, 15 characters per second.
def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mp3")).alias(
            "audio_filename"
        ),
        "text",
        (F.col("n_chars") / 15.0).alias("duration"),
        "source",
        F.col("lang").alias("language"),
    )


CORPUS = """corpus AS (
  SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.mp3' AS audio_filename, text,
         CAST(n_chars AS DOUBLE) / CAST(15 AS DOUBLE) AS duration, source, lang AS language
  FROM documents)"""


# Tagged rows: language and end time written into the text.
def tagged(spark: SparkSession, folder: str) -> DataFrame:
    whole = F.floor(F.col("n_chars") / 15)
    cents = F.floor((F.col("n_chars") % 15) * 100 / 15)
    return table(spark, folder, "documents").select(
        "doc_id",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mp3")).alias(
            "audio_filename"
        ),
        F.concat(
            F.lit("<|startoftranscript|><|"),
            "lang",
            F.lit("|><|transcribe|><|0.00|> "),
            "text",
            F.lit("<|"),
            whole.cast("string"),
            F.lit("."),
            F.lpad(cents.cast("string"), 2, "0"),
            F.lit("|><|endoftext|>"),
        ).alias("segment_timestamp"),
        "source",
    )


TAGGED = """tagged AS (
  SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.mp3' AS audio_filename,
         '<|startoftranscript|><|' || lang || '|><|transcribe|><|0.00|> ' || text || '<|'
         || CAST(n_chars // 15 AS VARCHAR) || '.'
         || lpad(CAST(((n_chars % 15) * 100) // 15 AS VARCHAR), 2, '0') || '|><|endoftext|>'
         AS segment_timestamp, source
  FROM documents),
parsed AS (
  SELECT doc_id, audio_filename, source,
         trim(regexp_replace(regexp_replace(segment_timestamp, '<\\|[^|]*\\|>', '', 'g'),
              '\\s+', ' ', 'g')) AS text,
         CAST(regexp_extract_all(segment_timestamp, '<\\|([0-9]+\\.[0-9]+)\\|>', 1)[-1] AS DOUBLE)
           AS duration,
         coalesce(nullif(regexp_extract(segment_timestamp, '<\\|([a-z]{2})\\|>', 1), ''), 'unknown')
           AS language
  FROM tagged)"""


# Accented letters as word characters of ASCII, so that SQL's word edges are those of Unicode.
LETTERS = "éóèñçüêäöíáúôâîûùàëï"


def sql_encoded(text: str) -> str:
    for i, letter in enumerate(LETTERS):
        for form, mark in ((letter, chr(97 + i)), (letter.upper(), chr(65 + i))):
            text = f"replace({text}, '{form}', '_{mark}_')"
    return f"replace({text}, 'ß', '_z_')"


def sql_decoded(text: str) -> str:
    for i, letter in enumerate(LETTERS):
        for form, mark in ((letter, chr(97 + i)), (letter.upper(), chr(65 + i))):
            text = f"replace({text}, '_{mark}_', '{form}')"
    return f"replace({text}, '_z_', 'ß')"


def sql_quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def sql_fold(text: str, pairs, flags: str = "(?i)") -> str:
    """Ordered regex replacements as nested calls."""
    for pattern, to in pairs:
        text = f"regexp_replace({text}, {sql_quote(flags + pattern)}, {sql_quote(to)}, 'g')"
    return text


# Utterances: the sentences of the conversation turns, and what three recognisers made of them.
MODELS = {"alpha": (10, 13), "beta": (7, 17), "gamma": (23, 5)}
DATASETS = ["user", "assistant", "system"]


def utterances(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    cut = turns.select(
        "conv_id", "turn", "role", F.posexplode(F.split("text", r"[.\n]+")).alias("part", "sentence")
    )
    return (
        cut.where(F.trim("sentence") != "")
        .select(
            F.concat_ws("-", "conv_id", "turn", "part").alias("utterance_id"),
            F.col("role").alias("dataset"),
            F.trim("sentence").alias("reference"),
            F.lit("ms").alias("language"),
            (F.col("conv_id") * 31 + F.col("turn") * 7 + F.col("part")).alias("number"),
        )
    )


def heard(utts: DataFrame, model: str) -> DataFrame:
    """Words dropped and replaced at fixed places of the reference."""
    drop, swap = MODELS[model]
    words = F.split("reference", r"\s+")
    number = F.col("number")
    kept = F.filter(
        F.transform(
            words,
            lambda w, i: F.when((number + i + 1) % drop == 0, F.lit(None))
            .when((number + i + 1) % swap == 0, F.lit("zz"))
            .otherwise(w),
        ),
        lambda w: w.isNotNull(),
    )
    return utts.select(
        F.lit(model).alias("model"),
        "dataset",
        "utterance_id",
        F.array_join(kept, " ").alias("hypothesis"),
    )


def all_heard(utts: DataFrame) -> DataFrame:
    out = None
    for model in MODELS:
        one = heard(utts, model)
        out = one if out is None else out.unionByName(one)
    return out


def sql_heard(model: str) -> str:
    drop, swap = MODELS[model]
    return (
        f"SELECT '{model}' AS model, dataset, utterance_id, reference, "
        "array_to_string(list_filter(list_transform(string_split_regex(reference, '\\s+'), "
        f"lambda w, i: CASE WHEN (number + i) % {drop} = 0 THEN NULL "
        f"WHEN (number + i) % {swap} = 0 THEN 'zz' ELSE w END), lambda w: w IS NOT NULL), ' ') "
        "AS hypothesis FROM utterances"
    )


UTTERANCES = """cut AS (
  SELECT conv_id, turn, role, unnest(string_split_regex(text, '[.\\n]+')) AS sentence,
         generate_subscripts(string_split_regex(text, '[.\\n]+'), 1) - 1 AS part
  FROM conversations),
utterances AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || '-' || CAST(part AS VARCHAR)
           AS utterance_id,
         role AS dataset, trim(sentence) AS reference, conv_id * 31 + turn * 7 + part AS number
  FROM cut WHERE trim(sentence) <> '')"""

HEARD = "heard AS (" + " UNION ALL ".join(sql_heard(m) for m in MODELS) + ")"


def sql_words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"


def sql_word_errors(ref: str, hyp: str) -> str:
    """Words become one-byte characters by their place among the distinct words of the pair."""
    known = f"list_distinct(list_concat({sql_words(ref)}, {sql_words(hyp)}))"
    code = lambda t: (
        f"coalesce(array_to_string(list_transform({sql_words(t)}, "
        f"lambda w: chr(CAST(list_position({known}, w) AS INTEGER))), ''), '')"
    )
    return f"CAST(levenshtein({code(ref)}, {code(hyp)}) AS BIGINT)"
