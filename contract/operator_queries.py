"""Filters, projections, joins, aggregations, windows, samples and set operations."""

from __future__ import annotations

import io
import wave

import pandas as pd
from pyspark.sql import functions as F

from contract.base import (
    CORPUS,
    DATASETS,
    HEARD,
    TAGGED,
    UTTERANCES,
    all_heard,
    corpus,
    heard,
    query,
    sql_squeeze,
    sql_word_errors,
    sql_words,
    table,
    tagged,
    utterances,
)
from contract.source_queries import flawed_records, keyed_files, paired_shards
from contract.text_queries import LOOPING_SQL, LOOPS, SQL_ZH_DONE, sql_compounds, sql_prepared_rows, sql_scoring_ms, zh_text
from tuturan.functions import arrow, language as L, scoring as S, text as X
from tuturan.operators import filters, joins, ranks, stats, vocab, wer
from tuturan.plans import benchmark, corpus as plan, speakers
from tuturan.session import scratch_path, store
from tuturan.sources import readers, writers

MAX_SECONDS = 600.0
r4 = lambda c: F.round(c, 4)
R = "round({}, 4)"


def draw_sql(key: str, seed: int = 42) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '|{seed}')"


def split_sql(by: str, key: str, ratio: float) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return (
        f"CASE WHEN row_number() OVER ({part} ORDER BY {draw_sql(key)}) <= "
        f"floor(count(*) OVER ({part}) * CAST({ratio} AS DOUBLE)) THEN 'train' ELSE 'val' END"
    )


# --------------------------------------------------------------------------------------------- audio headers
FILES_AT_ONCE = 64


def wav_files(spark, d):
    """Sound files of one supplier each, built by the tasks: 8 kHz, cut short for every seventh."""

    def sound(key):
        buffer = io.BytesIO()
        with wave.open(buffer, "wb") as out:
            out.setnchannels(1 + int(key) % 2)
            out.setsampwidth(2)
            out.setframerate(8000)
            out.writeframes(b"\0\0" * (1 + int(key) % 2) * (int(key) % 20 * 1000))
        return b"" if key % 7 == 0 else buffer.getvalue()

    def build(frames):
        for frame in frames:
            for start in range(0, len(frame), FILES_AT_ONCE):
                keys = frame["s_suppkey"].iloc[start : start + FILES_AT_ONCE]
                contents = [sound(k) for k in keys]
                yield pd.DataFrame(
                    {"path": [f"{k}.wav" for k in keys], "length": [len(c) for c in contents], "content": contents}
                )

    keys = table(spark, d, "supplier").select("s_suppkey")
    return keys.mapInPandas(build, "path string, length bigint, content binary")


@query(
    "src12_audio_headers",
    """SELECT CAST(s_suppkey AS VARCHAR) || '.wav' AS path,
  CASE WHEN s_suppkey % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE s_suppkey % 20 / CAST(8 AS DOUBLE) END AS duration,
  CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 8000 END AS sample_rate,
  CAST(CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 1 + s_suppkey % 2 END AS INTEGER) AS channels,
  s_suppkey % 7 <> 0 AND s_suppkey % 20 BETWEEN 4 AND 16 AS valid FROM supplier""",
)
def src12(spark, d):
    headers = arrow.read_wav_headers(wav_files(spark, d), 0.5, 2.0)
    return headers.select(
        "path", "duration", "sample_rate", "channels", (F.size("errors") == 0).alias("valid")
    )


@query(
    "udf4_wav_problems",
    """SELECT CAST(s_suppkey AS VARCHAR) || '.wav' AS path,
  CASE WHEN s_suppkey % 7 = 0 THEN 'truncated file'
    WHEN s_suppkey % 20 < 4 THEN 'Too short: ' || format('{:.2f}', s_suppkey % 20 / CAST(8 AS DOUBLE)) || 's < 0.5s'
    WHEN s_suppkey % 20 > 16 THEN 'Too long: ' || format('{:.2f}', s_suppkey % 20 / CAST(8 AS DOUBLE)) || 's > 2.0s'
    ELSE '' END AS problems FROM supplier""",
)
def udf4(spark, d):
    headers = arrow.read_wav_headers(wav_files(spark, d), 0.5, 2.0)
    return headers.select("path", F.array_join("errors", "; ").alias("problems"))


# --------------------------------------------------------------------------------------------------- filters
@query(
    "flt1_duration_between",
    f"WITH {CORPUS} SELECT doc_id, duration FROM corpus WHERE duration BETWEEN 0.1 AND 30.0",
)
def flt1(spark, d):
    return filters.duration_between(corpus(spark, d)).select("doc_id", "duration")


@query(
    "flt2_duration_if_known",
    f"WITH {CORPUS} SELECT doc_id, true AS known FROM corpus WHERE duration BETWEEN 0.1 AND 30.0 "
    "UNION ALL SELECT doc_id, false AS known FROM corpus",
)
def flt2(spark, d):
    rows = corpus(spark, d)
    known = filters.duration_between_if_known(rows)
    unknown = filters.duration_between_if_known(rows.withColumn("duration", F.lit(0.0)))
    return known.select("doc_id", F.lit(True).alias("known")).unionByName(
        unknown.select("doc_id", F.lit(False).alias("known"))
    )


@query(
    "flt3_language_counts",
    f"WITH {CORPUS} SELECT language, CAST(count(*) FILTER (language IN ('en', 'es')) AS BIGINT) AS kept, "
    "CAST(count(*) FILTER (language NOT IN ('en', 'es')) AS BIGINT) AS removed FROM corpus GROUP BY language",
)
def flt3(spark, d):
    return filters.language_counts(corpus(spark, d), ["en", "es"])


@query(
    "flt4_exclude_non_latin",
    "SELECT doc_id FROM documents WHERE doc_id % 13 > 11",
)
def flt4(spark, d):
    """Each of the twelve scripts shows up in one of thirteen documents."""
    samples = "好தعไжのक한বతאλ"
    place = (F.col("doc_id") % 13).cast("int") + 1
    marked = F.concat("text", F.substr(F.lit(samples), place, F.lit(1)))
    rows = table(spark, d, "documents").select("doc_id", marked.alias("text"))
    return rows.where(~X.contains_non_latin(F.col("text"))).select("doc_id")


ALLOWED_SQL = "^[a-zA-Z0-9\\s''\\-@À-ÖØ-öø-ÿĀ-ſ]+$"


@query(
    "flt5_valid_text",
    f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[.,!?;:\"%]', ' ', 'g') END AS text FROM documents) "
    f"SELECT doc_id, regexp_full_match(text, '{ALLOWED_SQL[1:-1]}') AND trim(text, ' \n') <> '' AS valid FROM t",
)
def flt5(spark, d):
    text = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", '[.,!?;:"%]', " "))
    return table(spark, d, "documents").select("doc_id", X.is_valid_text(text).alias("valid"))


@query(
    "flt6_invalid_characters",
    "SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[^a-zA-Z0-9\\s''\\-@À-ÖØ-öø-ÿĀ-ſ]'))), ''), '') AS invalid FROM documents",
)
def flt6(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.array_join(X.invalid_characters(F.col("text")), "").alias("invalid")
    )


@query(
    "flt7_text_problems",
    """SELECT doc_id, concat_ws('; ', CASE WHEN length(text) < 20 THEN 'Text too short: ' || CAST(length(text) AS VARCHAR) || ' < 20' END,
  CASE WHEN length(text) > 200 THEN 'Text too long: ' || CAST(length(text) AS VARCHAR) || ' > 200' END,
  CASE WHEN contains(text, '|') THEN 'Text contains pipe character' END) AS problems FROM documents""",
)
def flt7(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.array_join(filters.text_problems(F.col("text")), "; ").alias("problems")
    )


@query(
    "flt8_long_enough",
    f"SELECT doc_id FROM documents WHERE len({sql_words('text')}) >= 8 AND length(text) >= 100",
)
def flt8(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(filters.long_enough(F.col("text"), 8, 100)).select("doc_id")


@query(
    "flt9_validate_samples",
    """SELECT CASE WHEN doc_id % 4 <> 0 THEN '/data/' || CAST(doc_id AS VARCHAR) || '.wav' END AS audio_filepath,
  CASE WHEN doc_id % 4 = 1 THEN '' ELSE trim(text, ' \n') END AS text,
  CASE WHEN doc_id % 4 = 2 THEN CAST(0 AS DOUBLE) ELSE round(n_chars / CAST(15 AS DOUBLE), 6) END AS duration,
  CASE WHEN doc_id % 4 = 0 THEN 'missing audio path' WHEN doc_id % 4 = 1 THEN 'empty transcription'
    WHEN doc_id % 4 = 2 THEN 'bad duration' END AS error FROM documents""",
)
def flt9(spark, d):
    return filters.validate_samples(flawed_records(spark, d), "/data").withColumn("duration", F.round("duration", 6))


PREPARED = f"""{sql_prepared_rows('documents', "CASE WHEN lang = 'es' THEN 'ms' ELSE 'en' END", True)}, prepared AS (
  SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.mp3' AS audio_filename, lang AS language, source,
         CAST(n_chars AS DOUBLE) / CAST(15 AS DOUBLE) AS duration, text FROM ready)"""
OPTIONS = dict(
    max_duration=MAX_SECONDS, languages=("en", "fr", "id"), clean_for_asr=True, filter_invalid_chars=True, key=("doc_id",), unique_key=True
)


def routed_corpus(spark, d):
    """The texts as they are; es is tagged as id, which takes the Malay route."""
    language = F.when(F.col("language") == "es", "id").otherwise(F.col("language"))
    return corpus(spark, d).withColumn("language", language)


@query(
    "flt10_attrition",
    f"""WITH {PREPARED}, r AS (SELECT CASE WHEN duration NOT BETWEEN 0.1 AND {MAX_SECONDS} THEN 1
    WHEN language NOT IN ('en', 'fr', 'es') THEN 2 WHEN text = '' THEN 4 ELSE 6 END AS step FROM prepared),
s AS (SELECT unnest([1, 2, 3, 4, 5]) AS step, unnest(['duration', 'language', 'script', 'empty', 'characters']) AS stage)
SELECT CAST(s.step AS BIGINT) AS step, stage, CAST(count(*) FILTER (r.step = s.step) AS BIGINT) AS dropped,
  CAST(count(*) FILTER (r.step > s.step) AS BIGINT) AS remaining FROM s, r GROUP BY s.step, stage""",
)
def flt10(spark, d):
    return plan.corpus_attrition(routed_corpus(spark, d), plan.CorpusOptions(**OPTIONS))


@query(
    "prepare_corpus",
    f"""WITH {PREPARED}, kept AS (SELECT * FROM prepared WHERE duration BETWEEN 0.1 AND {MAX_SECONDS}
  AND language IN ('en', 'fr', 'es') AND text <> '')
SELECT doc_id, text, {split_sql('source', 'doc_id', 0.95)} AS split FROM kept""",
)
def prepare_corpus(spark, d):
    prepared = plan.prepare_corpus(routed_corpus(spark, d), plan.CorpusOptions(**OPTIONS))
    return prepared.select("doc_id", "text", "split")


def inventory(spark, d):
    """Audio of four in five documents."""
    return corpus(spark, d).where("doc_id % 5 <> 0").select("audio_filename")


@query(
    "flt10_attrition_audio",
    f"""WITH {PREPARED}, r AS (SELECT CASE WHEN duration NOT BETWEEN 0.1 AND {MAX_SECONDS} THEN 1
    WHEN language NOT IN ('en', 'fr', 'es') THEN 2 WHEN text = '' THEN 4 WHEN doc_id % 5 = 0 THEN 6 ELSE 7 END AS step FROM prepared),
s AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS step, unnest(['duration', 'language', 'script', 'empty', 'characters', 'audio']) AS stage)
SELECT CAST(s.step AS BIGINT) AS step, stage, CAST(count(*) FILTER (r.step = s.step) AS BIGINT) AS dropped,
  CAST(count(*) FILTER (r.step > s.step) AS BIGINT) AS remaining FROM s, r GROUP BY s.step, stage""",
)
def flt10_audio(spark, d):
    return plan.corpus_attrition(routed_corpus(spark, d), plan.CorpusOptions(**OPTIONS), inventory(spark, d))


@query(
    "build_corpus",
    f"""WITH {PREPARED}, kept AS (SELECT * FROM prepared WHERE duration BETWEEN 0.1 AND {MAX_SECONDS} AND doc_id % 5 <> 0
  AND language IN ('en', 'fr', 'es') AND text <> ''), s AS (SELECT *, {split_sql('source', 'doc_id', 0.95)} AS split FROM kept)
SELECT split, '/data/' || audio_filename AS audio_filepath, text, duration, CAST(count(*) OVER (PARTITION BY split) AS BIGINT) AS samples FROM s""",
)
def build_corpus(spark, d):
    """Read back from the manifests and the statistics that a whole run has written."""
    output = scratch_path(spark, "corpus")
    statistics = plan.build_corpus(
        routed_corpus(spark, d), output, "/data", plan.CorpusOptions(**OPTIONS, spot_check=20), inventory(spark, d)
    )
    sides = [readers.read_manifest(spark, f"{output}/{s}").withColumn("split", F.lit(s)) for s in ("train", "val")]
    return joins.concatenate(sides).join(statistics.select("split", "samples"), "split")


@query(
    "build_paired_corpus",
    f"""WITH {TAGGED}, known AS (SELECT *, CASE WHEN doc_id % 3 <> 0 AND CAST(substr(source, 4) AS INTEGER) % 2 = 0 THEN duration ELSE 0 END AS seconds
  FROM parsed WHERE text <> ''), kept AS (SELECT * FROM known WHERE seconds BETWEEN 0.1 AND {MAX_SECONDS} AND doc_id % 5 <> 0),
s AS (SELECT *, {split_sql('source', 'audio_filename', 0.95)} AS split FROM kept)
SELECT split, CAST(count(*) AS BIGINT) AS samples, round(sum(seconds), 4) AS seconds FROM s GROUP BY split""",
)
def build_paired_corpus(spark, d):
    output = scratch_path(spark, "paired")
    options = plan.CorpusOptions(max_duration=MAX_SECONDS, unique_key=True)
    written = plan.build_paired_corpus(spark, paired_shards(spark, d), output, "/data", options, inventory(spark, d))
    return written.select("split", "samples", F.round("total_duration", 4).alias("seconds"))


@query(
    "build_speaker_corpus",
    f"""WITH {CORPUS}, c AS (SELECT doc_id, audio_filename AS file, replace(text, chr(10), ' ') AS text, language AS speaker, duration FROM corpus),
kept AS (SELECT * FROM c WHERE length(text) BETWEEN 20 AND 2000 AND NOT contains(text, '|') AND duration BETWEEN 3 AND {MAX_SECONDS}),
s AS (SELECT *, {split_sql('speaker', 'file', 0.9)} AS split FROM kept)
SELECT s.speaker, s.split, file || '|' || text || '|' || s.speaker AS line, CAST(count(*) OVER (PARTITION BY s.speaker, s.split) AS BIGINT) AS samples FROM s""",
)
def build_speaker_corpus(spark, d):
    """Each language is a speaker; the lines are read back from the written files."""
    output = scratch_path(spark, "speakers")
    rows = corpus(spark, d).select(
        F.col("audio_filename").alias("file"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"),
        F.col("language").alias("speaker"), "duration",
    )
    counts = speakers.build_speaker_corpus(
        rows, output, text_limits=(20, 2000), duration=(3.0, MAX_SECONDS), unique_key=True
    )
    read = lambda part, side: spark.read.text(f"{output}/{part}").select(
        F.lit(side).alias("split"), F.col("value").alias("line"), F.substring_index("value", "|", -1).alias("speaker")
    )
    lines = joins.concatenate([read("train", "train"), read("eval", "val")])
    return lines.join(counts.select("speaker", "split", "samples"), ["speaker", "split"])


@query(
    "prepare_tagged_corpus",
    f"""WITH {TAGGED}, kept AS (SELECT * FROM parsed WHERE text <> '' AND duration BETWEEN 0.1 AND {MAX_SECONDS}
  AND language IN ('en', 'fr', 'es')),
split AS (SELECT *, {split_sql('source', 'audio_filename', 0.95)} AS split FROM kept)
SELECT source, split, CAST(count(*) AS BIGINT) AS samples, round(sum(duration) / 3600, 6) AS hours,
  round(avg(length(text)), 4) AS avg_chars FROM split GROUP BY source, split""",
)
def prepare_tagged_corpus(spark, d):
    """Tagged rows parsed, filtered, split by source and summarised.

    Hours keep six decimals: sums of hundredths of a second never lie halfway there.
    """
    rows = readers.tagged_corpus(tagged(spark, d))
    kept = filters.keep_languages(filters.duration_between(rows, high=MAX_SECONDS), ["en", "fr", "es"])
    split = ranks.stratified_split(store(kept, "kept"), ["source"], ["audio_filename"], 0.95, unique_key=True)
    summary = stats.corpus_statistics(split, ["source", "split"])
    return summary.select(
        "source", "split", "samples", F.round("hours", 6).alias("hours"), r4("avg_chars").alias("avg_chars")
    )


# ----------------------------------------------------------------------------------------------- projections
@query(
    "prj1_paths",
    """SELECT doc_id, '/new/' || source || '/' || CAST(doc_id AS VARCHAR) || '.mp3' AS rebased,
  CAST(doc_id AS VARCHAR) || '.mp3' AS file, CAST(doc_id AS VARCHAR) AS stem,
  '/base/' || source || '/' || CAST(doc_id AS VARCHAR) || '.mp3' AS absolute FROM documents""",
)
def prj1(spark, d):
    rows = corpus(spark, d)
    full = F.concat(F.lit("/old/place/"), F.col("audio_filename"))
    return rows.select(
        "doc_id",
        filters.rebase_path(full, "/old/place/", "/new/").alias("rebased"),
        filters.base_name(full).alias("file"),
        filters.stem(full).alias("stem"),
        filters.absolute_path(F.col("audio_filename"), "/base").alias("absolute"),
    )


@query(
    "prj2_id_category",
    "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'OTHER' ELSE substring(o_orderpriority, 3) END AS category, "
    "CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1",
)
def prj2(spark, d):
    uid = F.when(F.col("o_orderkey") % 5 == 0, "BANK").otherwise(
        F.concat(F.lit("BANK_"), F.substring("o_orderpriority", 3, 100), F.lit("_1"))
    )
    rows = table(spark, d, "orders").select(filters.id_category(uid).alias("category"))
    return stats.counts_by(rows, "category")


@query(
    "prj3_speaker_id",
    "SELECT s_suppkey, CAST(CASE s_nationkey WHEN 3 THEN 0 WHEN 7 THEN 1 WHEN 11 THEN 2 ELSE 3 END AS INTEGER) AS speaker FROM supplier",
)
def prj3(spark, d):
    names = {"NATION_3": 0, "NATION_7": 1, "NATION_11": 2}
    joined = joins.enrich(
        table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"),
        table(spark, d, "nation"),
        "n_nationkey",
        ["n_name"],
    )
    return joined.select("s_suppkey", filters.speaker_id(F.col("n_name"), names).alias("speaker"))


@query(
    "prj4_sequential_names",
    "SELECT doc_id, source || '_' || lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY k NULLS LAST, doc_id) - 1 AS VARCHAR), 8, '0') || '.wav' AS file, "
    "'audio_' || lpad(CAST(row_number() OVER (ORDER BY k NULLS LAST, doc_id) AS VARCHAR), 6, '0') || '.wav' AS global_file "
    "FROM (SELECT *, CASE WHEN doc_id % 5 <> 0 THEN n_chars // 100 END AS k FROM documents)",
)
def prj4(spark, d):
    """The order has nulls and many equal values."""
    k = F.when(F.col("doc_id") % 5 != 0, F.floor(F.col("n_chars") / 100)).alias("k")
    docs = table(spark, d, "documents").select("doc_id", "source", k)
    rows = ranks.number_rows(docs, "k", ["source"], "in_source", then=["doc_id"], unique_key=True)
    rows = ranks.number_rows(rows, "k", name="overall", then=["doc_id"], unique_key=True)
    return rows.select(
        "doc_id",
        filters.file_number(F.concat("source", F.lit("_")), F.col("in_source") - 1, 8, ".wav").alias("file"),
        filters.file_number(F.lit("audio_"), F.col("overall"), 6, ".wav").alias("global_file"),
    )


# ----------------------------------------------------------------------------------------------------- joins
@query(
    "join1_match_utterances",
    f"""SELECT 'utt' || CAST(doc_id AS VARCHAR) AS utt_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE {sql_squeeze('text')} END AS text,
  'wav/' || CAST(doc_id AS VARCHAR) || '.wav' AS audio_path FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 11 <> 0""",
)
def join1(spark, d):
    texts, wavs = keyed_files(spark, d)
    return joins.match_utterances(readers.read_transcripts(spark, texts), readers.read_audio_paths(spark, wavs))


@query(
    "join2_word_durations",
    f"""WITH {TAGGED} SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN duration ELSE CAST(0 AS DOUBLE) END AS duration FROM parsed WHERE text <> ''""",
)
def join2(spark, d):
    """Word shards lack a third of the files and hold every tenth file twice."""
    rows = tagged(spark, d).withColumnRenamed("segment_timestamp", "new_text")
    words = rows.where("doc_id % 3 <> 0")
    copies = words.where("doc_id % 10 = 0").withColumn("new_text", F.concat("new_text", F.lit("<|99999.00|>")))
    durations = joins.word_durations(words.unionByName(copies))
    segments = readers.paired_segments(rows, keep=("doc_id",))
    return joins.attach_durations(segments, durations).select("doc_id", "duration")


@query(
    "join3_having_audio",
    "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def join3(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return joins.having_audio(docs, table(spark, d, "labels"), "doc_id")


@query(
    "join4_missing_audio",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def join4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return joins.missing_audio(docs, table(spark, d, "labels"), "doc_id")


@query(
    "join4_spot_check",
    f"""WITH s AS (SELECT doc_id FROM documents ORDER BY {draw_sql('doc_id')} LIMIT 100)
SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS found FROM s""",
)
def join4_spot(spark, d):
    """A hundred sampled rows are looked up, the others are not."""
    docs = table(spark, d, "documents")
    return joins.spot_check(docs, table(spark, d, "labels"), "doc_id", 100)


def one_run(spark, d, model, every=0):
    """Hypotheses of one model; every n-th utterance was not recognised."""
    utts = utterances(spark, d)
    hyps = heard(utts.where(F.col("number") % every != 0) if every else utts, model)
    return utts, hyps.drop("model", "dataset")


RUN = f"WITH {UTTERANCES}, {HEARD}"
ERRORS = sql_word_errors("reference", "hypothesis")


@query(
    "join5_hypothesis_reference",
    f"""{RUN}, p AS (SELECT h.dataset, {sql_word_errors('h.reference', 'h.hypothesis')} AS errors, CAST(len({sql_words('h.reference')}) AS BIGINT) AS ref_words
  FROM heard h JOIN utterances u USING (utterance_id, dataset) WHERE model = 'alpha' AND number % 6 <> 0)
SELECT dataset, CAST(count(*) AS BIGINT) AS samples, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(ref_words) AS BIGINT) AS ref_words,
  round(sum(errors) / CAST(sum(ref_words) AS DOUBLE), 6) AS wer FROM p GROUP BY dataset""",
)
def join5(spark, d):
    utts, hyps = one_run(spark, d, "alpha", 6)
    scored = wer.score_utterances(wer.pair_with_reference(hyps, utts))
    return wer.corpus_wer(scored, ["dataset"]).withColumn("wer", F.round("wer", 6))


@query(
    "join6_failed_as_deletions",
    f"""{RUN}, p AS (SELECT u.dataset, u.reference, CASE WHEN number % 6 <> 0 THEN hypothesis ELSE '' END AS hypothesis
  FROM heard h JOIN utterances u USING (utterance_id, dataset) WHERE model = 'alpha'),
e AS (SELECT dataset, {ERRORS} AS errors, CAST(len({sql_words('reference')}) AS BIGINT) AS ref_words FROM p)
SELECT dataset, CAST(count(*) AS BIGINT) AS samples, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(ref_words) AS BIGINT) AS ref_words,
  round(sum(errors) / CAST(sum(ref_words) AS DOUBLE), 6) AS wer FROM e GROUP BY dataset""",
)
def join6(spark, d):
    utts, hyps = one_run(spark, d, "alpha", 6)
    scored = wer.score_utterances(wer.pair_with_reference(hyps, utts, keep_failed=True))
    return wer.corpus_wer(scored, ["dataset"]).withColumn("wer", F.round("wer", 6))


@query(
    "join7_not_yet_written",
    f"""SELECT doc_id FROM documents WHERE lower(trim(text, ' \n')) NOT IN
  (SELECT lower(trim(text, ' \n')) FROM documents WHERE source IN ('src0', 'src1', 'src2'))""",
)
def join7(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    earlier = docs.where(F.col("source").isin("src0", "src1", "src2"))
    return joins.not_yet_written(docs, earlier).select("doc_id")


FREQUENT = """f AS (SELECT word FROM (SELECT unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[.,!?;:"''\\-()\\[\\]{}…«»—–]', ' ', 'g'), '\\s+'), lambda w: w <> '')) AS word FROM documents)
  GROUP BY word HAVING count(*) >= 20)"""
TOKENS = "regexp_extract_all(text, '[\\pL\\pN_'']+|[^\\pL\\pN_\\s]+|\\s+')"


@query(
    "join9_to_phonemes",
    f"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS token, generate_subscripts({TOKENS}, 1) AS pos FROM documents), {FREQUENT}
SELECT doc_id % 50 AS shelf, source, string_agg(coalesce('/' || reverse(word) || '/', token), '' ORDER BY pos) AS phonemes
FROM t LEFT JOIN f ON lower(token) = word JOIN documents USING (doc_id) GROUP BY doc_id, source""",
)
def join9(spark, d):
    """The most frequent words of the corpus get their letters reversed; many rows share a shelf."""
    docs = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("shelf"), "source", "text")
    frequent = vocab.word_frequency(docs, 20)
    reversed_word = F.concat(F.lit("/"), F.reverse("word"), F.lit("/"))
    spoken = vocab.to_phonemes(docs, frequent.select("word", reversed_word.alias("phonemes")))
    return spoken.select("shelf", "source", "phonemes")


def vocabulary(spark, d, half, first_id):
    """Distinct words of one half of the sources, numbered by a checksum."""
    odd = F.substring("source", 4, 9).cast("int") % 2 == half
    words = vocab.word_frequency(table(spark, d, "documents").where(odd))
    numbered = words.select(F.col("word").alias("token"), F.crc32(F.col("word")).alias("id"))
    return numbered.withColumn("id", F.col("id") + first_id)


def vocabulary_sql(half: int) -> str:
    return (
        "(SELECT DISTINCT unnest(list_filter(string_split_regex(regexp_replace(lower(text), "
        "'[.,!?;:\"''\\-()\\[\\]{}…«»—–]', ' ', 'g'), '\\s+'), lambda w: w <> '')) AS token "
        f"FROM documents WHERE CAST(substr(source, 4) AS INTEGER) % 2 = {half})"
    )


def numbered_vocabulary(spark, d, half):
    """Words of one half of the sources, numbered by their frequency."""
    odd = F.substring("source", 4, 9).cast("int") % 2 == half
    words = vocab.word_frequency(table(spark, d, "documents").where(odd)).withColumn("rare", -F.col("freq"))
    return ranks.number_rows(words.withColumnRenamed("word", "token"), "rare", name="id", then=["token"], unique_key=True)


def numbered_sql(half: int) -> str:
    listed = vocabulary_sql(half).replace("SELECT DISTINCT", "SELECT", 1)
    return f"(SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM {listed} GROUP BY token)"


@query(
    "join10_map_vocabulary_ids",
    f"SELECT a.token, a.id AS old_id, b.id AS new_id FROM {numbered_sql(0)} a JOIN {numbered_sql(1)} b ON a.token = b.token",
)
def join10(spark, d):
    """Two vocabularies number their common words by different frequencies."""
    return vocab.map_vocabulary_ids(numbered_vocabulary(spark, d, 0), numbered_vocabulary(spark, d, 1))


@query(
    "join11_new_tokens",
    f"SELECT token FROM {vocabulary_sql(1)} WHERE token NOT IN (SELECT token FROM {vocabulary_sql(0)})",
)
def join11(spark, d):
    return vocab.new_tokens(vocabulary(spark, d, 1, 0), vocabulary(spark, d, 0, 0)).select("token")


def scored_runs(spark, d):
    utts = utterances(spark, d)
    pairs = all_heard(utts).join(utts.select("dataset", "utterance_id", "reference"), ["dataset", "utterance_id"])
    return wer.score_utterances(pairs)


SCORED = f"""{RUN}, scored AS (SELECT model, dataset, utterance_id, {ERRORS} AS errors,
  CAST(len({sql_words('reference')}) AS BIGINT) AS ref_words FROM heard),
rated AS (SELECT *, errors / CAST(ref_words AS DOUBLE) AS wer FROM scored)"""
COMPARED = f"""{SCORED}, compared AS (SELECT a.dataset, a.utterance_id, a.wer AS base_wer, b.wer AS other_wer, b.wer - a.wer AS delta,
  CASE WHEN b.wer < a.wer THEN 'better' WHEN b.wer > a.wer THEN 'worse' ELSE 'same' END AS verdict
  FROM rated a JOIN rated b USING (dataset, utterance_id) WHERE a.model = 'alpha' AND b.model = 'beta')"""
KEY = ["dataset", "utterance_id"]


def compared(spark, d):
    """Two runs of the same test sets, each hypothesis scored against its own reference."""
    utts = utterances(spark, d)
    references = utts.select("dataset", "utterance_id", "reference")
    run = lambda m: wer.score_utterances(heard(utts, m).join(references, KEY))
    return wer.compare_runs(run("alpha"), run("beta"), KEY)


@query("join12_compare_runs", f"{COMPARED} SELECT dataset, utterance_id, round(base_wer, 6) AS base_wer, round(other_wer, 6) AS other_wer, round(delta, 6) AS delta, verdict FROM compared")
def join12(spark, d):
    rounded = {c: F.round(c, 6) for c in ("base_wer", "other_wer", "delta")}
    return compared(spark, d).withColumns(rounded)


@query(
    "join13_enrich",
    "SELECT doc_id, language, CASE language WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' END AS name FROM "
    "(SELECT doc_id, lang AS language FROM documents)",
)
def join13(spark, d):
    registry = spark.createDataFrame([("en", "English"), ("fr", "French")], "language string, name string")
    return joins.enrich(corpus(spark, d).select("doc_id", "language"), registry, "language", ["name"])


# ---------------------------------------------------------------------------------------------- aggregations
STATS_SQL = (
    "CAST(count(*) AS BIGINT) AS samples, round(sum(duration), 4) AS total_duration, round(sum(duration) / 3600, 4) AS hours, "
    "round(avg(duration), 4) AS avg_duration, round(min(duration), 4) AS min_duration, round(max(duration), 4) AS max_duration, "
    "round(avg(length(text)), 4) AS avg_chars"
)


def rounded(df, *keep):
    return df.select(*[c if t in ("bigint", "string", "int", "boolean") or c in keep else F.round(c, 4).alias(c) for c, t in df.dtypes])


@query("agg1_corpus_statistics", f"WITH {CORPUS} SELECT {STATS_SQL} FROM corpus")
def agg1(spark, d):
    return rounded(stats.corpus_statistics(corpus(spark, d)))


@query(
    "agg2_statistics_by_source",
    f"WITH {CORPUS} SELECT source, {STATS_SQL}, round(count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER (), 4) AS share FROM corpus GROUP BY source",
)
def agg2(spark, d):
    return rounded(stats.statistics_with_share(corpus(spark, d), ["source"]))


@query("agg3_counts", "SELECT lang AS language, source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang, source")
def agg3(spark, d):
    return stats.counts_by(corpus(spark, d), "language", "source")


@query(
    "agg4_length_distribution",
    """SELECT source, CAST(count(*) AS BIGINT) AS samples, round(avg(length(text)), 4) AS mean_chars,
  CAST(quantile_cont(length(text), 0.5) AS DOUBLE) AS median_chars, CAST(min(length(text)) AS BIGINT) AS min_chars,
  CAST(max(length(text)) AS BIGINT) AS max_chars, round(stddev_pop(length(text)), 3) AS std_chars FROM documents GROUP BY source""",
)
def agg4(spark, d):
    out = stats.length_distribution(corpus(spark, d), ["source"])
    return out.withColumns({"mean_chars": F.round("mean_chars", 4), "std_chars": F.round("std_chars", 3)})


@query(
    "agg5_corpus_wer",
    f"{SCORED} SELECT model, CAST(count(*) AS BIGINT) AS samples, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(ref_words) AS BIGINT) AS ref_words, round(sum(errors) / CAST(sum(ref_words) AS DOUBLE), 6) AS wer FROM scored GROUP BY model",
)
def agg5(spark, d):
    return wer.corpus_wer(scored_runs(spark, d), ["model"]).withColumn("wer", F.round("wer", 6))


@query(
    "agg6_utterance_wer",
    f"{SCORED} SELECT model, dataset, utterance_id, errors, ref_words, round(wer, 6) AS wer FROM rated",
)
def agg6(spark, d):
    scored = scored_runs(spark, d).withColumn("wer", F.round("wer", 6))
    return scored.select("model", "dataset", "utterance_id", "errors", "ref_words", "wer")


@query(
    "txt20_word_errors",
    f"{SCORED} SELECT utterance_id, errors FROM scored WHERE model = 'gamma'",
)
def txt20(spark, d):
    utts = utterances(spark, d)
    pairs = heard(utts, "gamma").join(utts.select("dataset", "utterance_id", "reference"), ["dataset", "utterance_id"])
    return pairs.select("utterance_id", S.word_errors(F.col("reference"), F.col("hypothesis")).alias("errors"))


# One unused ASCII character for each accented letter, as SQL measures distances in bytes.
ACCENTS = "éóèñüçäöêßíÉÈÑÓÇÊÜÖÄÍ"
UNUSED = " || ".join(f"chr({c})" for c in [*range(1, 9), 11, 12, *range(14, 25)])
ASCII_PAIR = f"translate({{0}}, '{ACCENTS}', {UNUSED})"


@query(
    "agg7_edit_breakdown",
    f"""{RUN}, t AS (SELECT model, {ERRORS} AS errors, len({sql_words('reference')}) AS ref_words, len({sql_words('hypothesis')}) AS hyp_words,
  levenshtein({ASCII_PAIR.format('reference')}, {ASCII_PAIR.format('hypothesis')}) AS char_errors, length(reference) AS ref_chars FROM heard)
SELECT model, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(hyp_words - ref_words) AS BIGINT) AS surplus, CAST(sum(ref_words) AS BIGINT) AS ref_words,
  round(sum(errors) / CAST(sum(ref_words) AS DOUBLE), 6) AS wer, round(sum(char_errors) / CAST(sum(ref_chars) AS DOUBLE), 6) AS cer FROM t GROUP BY model""",
)
def agg7(spark, d):
    """Insertions minus deletions is the surplus of words."""
    utts = utterances(spark, d)
    pairs = all_heard(utts).join(utts.select("dataset", "utterance_id", "reference"), ["dataset", "utterance_id"])
    out = wer.edit_breakdown(pairs, ["model"])
    errors = F.col("substitutions") + F.col("insertions") + F.col("deletions")
    return out.select(
        "model",
        errors.alias("errors"),
        (F.col("insertions") - F.col("deletions")).alias("surplus"),
        "ref_words",
        F.round("wer", 6).alias("wer"),
        F.round("cer", 6).alias("cer"),
    )


UNIT = 1_000_000  # an edit; one more for a substitution


@query(
    "agg7_edit_operations",
    f"""{RUN.replace("WITH", "WITH RECURSIVE", 1)}, pairs AS (SELECT model, dataset, utterance_id, {sql_words('reference')} AS r, {sql_words('hypothesis')} AS h FROM heard),
ed AS (SELECT model, dataset, utterance_id, CAST(0 AS BIGINT) AS i, list_transform(range(0, len(h) + 1), lambda j: j * {UNIT}) AS costs FROM pairs
  UNION ALL
  SELECT model, dataset, utterance_id, i + 1, list_transform(range(1, len(h) + 2), lambda j: list_min(list_transform(range(1, j + 1),
    lambda k: CASE WHEN k = 1 THEN (i + 1) * {UNIT} ELSE least(costs[k - 1] + CASE WHEN r[i + 1] = h[k - 1] THEN 0 ELSE {UNIT} + 1 END, costs[k] + {UNIT}) END
      + (j - k) * {UNIT}))) FROM ed JOIN pairs USING (model, dataset, utterance_id) WHERE i < len(r)),
done AS (SELECT model, dataset, len(r) AS n, len(h) - len(r) AS surplus, costs[-1] // {UNIT} AS errors, costs[-1] % {UNIT} AS subs
  FROM ed JOIN pairs USING (model, dataset, utterance_id) WHERE i = len(r)),
ops AS (SELECT *, (errors - subs + surplus) // 2 AS ins, (errors - subs - surplus) // 2 AS dels FROM done)
SELECT model, dataset, CAST(sum(subs) AS BIGINT) AS substitutions, CAST(sum(ins) AS BIGINT) AS insertions, CAST(sum(dels) AS BIGINT) AS deletions,
  CAST(sum(n - subs - dels) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS ref_words, round(sum(errors) / CAST(sum(n) AS DOUBLE), 6) AS wer
FROM ops GROUP BY model, dataset""",
)
def agg7_operations(spark, d):
    utts = utterances(spark, d)
    pairs = all_heard(utts).join(utts.select("dataset", "utterance_id", "reference"), ["dataset", "utterance_id"])
    out = wer.edit_breakdown(pairs, ["model", "dataset"]).withColumn("wer", F.round("wer", 6))
    return out.drop("char_errors", "ref_chars", "cer")


CELLS = f"{SCORED}, cells AS (SELECT model, dataset, round(sum(errors) / CAST(sum(ref_words) AS DOUBLE), 6) AS wer FROM scored WHERE NOT (model = 'gamma' AND dataset = 'user') GROUP BY model, dataset)"


@query(
    "agg8_wer_matrix",
    f"{CELLS} SELECT model, coalesce(max(wer) FILTER (dataset = 'user'), CAST('nan' AS DOUBLE)) AS \"user\", "
    "coalesce(max(wer) FILTER (dataset = 'assistant'), CAST('nan' AS DOUBLE)) AS assistant, coalesce(max(wer) FILTER (dataset = 'system'), CAST('nan' AS DOUBLE)) AS system FROM cells GROUP BY model",
)
def agg8(spark, d):
    """One cell was not run and shows as NaN."""
    scored = scored_runs(spark, d).where("NOT (model = 'gamma' AND dataset = 'user')")
    long = wer.corpus_wer(scored, ["model", "dataset"]).withColumn("wer", F.round("wer", 6))
    return wer.wer_matrix(long, DATASETS)


@query(
    "snk6_results_summary",
    f"{CELLS} SELECT model, max(wer) FILTER (dataset = 'user') AS \"user\", max(wer) FILTER (dataset = 'assistant') AS assistant, max(wer) FILTER (dataset = 'system') AS system FROM cells GROUP BY model",
)
def snk6(spark, d):
    scored = scored_runs(spark, d).where("NOT (model = 'gamma' AND dataset = 'user')")
    long = wer.corpus_wer(scored, ["model", "dataset"]).withColumn("wer", F.round("wer", 6))
    path = scratch_path(spark, "summary")
    writers.write_summary(wer.wer_matrix(long, DATASETS), path)
    back = spark.read.option("header", "true").schema("model string, user double, assistant double, system double").csv(path)
    return back.select("model", *[F.nanvl(c, F.lit(None)).alias(c) for c in DATASETS])


@query(
    "agg9_best_checkpoint",
    f"{CELLS} SELECT dataset, arg_min(model, wer) AS best_checkpoint, min(wer) AS wer FROM cells GROUP BY dataset",
)
def agg9(spark, d):
    scored = scored_runs(spark, d).where("NOT (model = 'gamma' AND dataset = 'user')")
    cells = wer.corpus_wer(scored, ["model", "dataset"]).withColumn("wer", F.round("wer", 6))
    return wer.best_checkpoint(cells.withColumnRenamed("model", "checkpoint"), ["dataset"])


@query(
    "agg10_comparison_summary",
    f"{COMPARED} SELECT CAST(count(*) FILTER (verdict = 'better') AS BIGINT) AS better, CAST(count(*) FILTER (verdict = 'worse') AS BIGINT) AS worse, "
    "CAST(count(*) FILTER (verdict = 'same') AS BIGINT) AS same, CAST(count(*) FILTER (verdict = 'better') - count(*) FILTER (verdict = 'worse') AS BIGINT) AS net, "
    "round((count(*) FILTER (verdict = 'better') - count(*) FILTER (verdict = 'worse')) * CAST(100 AS DOUBLE) / count(*), 4) AS net_percent FROM compared",
)
def agg10(spark, d):
    return rounded(wer.comparison_summary(compared(spark, d)))


@query(
    "agg11_char_frequency",
    "SELECT token, CAST(count(*) AS BIGINT) AS freq FROM (SELECT unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS token FROM documents) GROUP BY token",
)
def agg11(spark, d):
    return vocab.char_frequency(table(spark, d, "documents"))


@query(
    "agg11_char_frequency_cjk",
    "SELECT token, CAST(count(*) AS BIGINT) AS freq FROM (SELECT unnest(regexp_extract_all(translate(text, 'aeiou', '我你他的是'), '[一-鿿]')) AS token FROM documents) GROUP BY token",
)
def agg11_cjk(spark, d):
    docs = table(spark, d, "documents").select(F.translate("text", "aeiou", "我你他的是").alias("text"))
    return vocab.char_frequency(docs, ["cjk", "hangul"])


@query(
    "agg12_word_frequency",
    "SELECT word, CAST(count(*) AS BIGINT) AS freq FROM (SELECT unnest(list_filter(string_split_regex(regexp_replace(lower(text), "
    "'[.,!?;:\"''\\-()\\[\\]{}…«»—–]', ' ', 'g'), '\\s+'), lambda w: w <> '')) AS word FROM documents) GROUP BY word HAVING count(*) >= 3",
)
def agg12(spark, d):
    return vocab.word_frequency(table(spark, d, "documents"), 3)


@query(
    "agg13_vocabulary_coverage",
    f"""WITH v AS {vocabulary_sql(0)},
t AS (SELECT doc_id, lang AS language, unnest({sql_words('text')}) AS token FROM documents),
s AS (SELECT doc_id, language, count(*) AS total, count(*) FILTER (v.token IS NULL) AS unknown FROM t LEFT JOIN v ON t.token = v.token GROUP BY doc_id, language)
SELECT language, CAST(count(*) AS BIGINT) AS sentences, round(avg((total - unknown) / CAST(total AS DOUBLE)), 6) AS avg_coverage, CAST(sum(total) AS BIGINT) AS total_tokens,
  CAST(sum(unknown) AS BIGINT) AS total_unknown, round(sum(unknown) / CAST(sum(total) AS DOUBLE), 6) AS unknown_ratio,
  avg((total - unknown) / CAST(total AS DOUBLE)) >= 0.8 AND sum(unknown) / CAST(sum(total) AS DOUBLE) < 0.2 AS supported FROM s GROUP BY language""",
)
def agg13(spark, d):
    docs = corpus(spark, d).select("doc_id", "language", "text")
    out = vocab.vocabulary_coverage(docs, vocabulary(spark, d, 0, 0), "doc_id", "language")
    return out.withColumns({c: F.round(c, 6) for c in ("avg_coverage", "unknown_ratio")})


@query(
    "agg14_repetition_rate",
    f"""WITH {LOOPING_SQL} SELECT lang, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (flagged) AS BIGINT) AS flagged,
  round(avg(CAST(flagged AS INTEGER)) * 100, 4) AS rate_percent FROM detected JOIN documents USING (doc_id) GROUP BY lang""",
)
def agg14(spark, d):
    looped = table(spark, d, "documents").select("lang", F.expr(LOOPS).alias("text"))
    return stats.repetition_rate(looped, ["lang"]).withColumn("rate_percent", F.round("rate_percent", 4))


@query(
    "agg15_success_rate",
    "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (doc_id % 4 = 3) AS BIGINT) AS valid, "
    "round(count(*) FILTER (doc_id % 4 = 3) * CAST(100 AS DOUBLE) / count(*), 4) AS success_percent FROM documents",
)
def agg15(spark, d):
    return rounded(stats.success_rate(filters.validate_samples(flawed_records(spark, d), "/data")))


@query(
    "agg15_skip_report",
    """WITH c AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'missing audio path' WHEN doc_id % 4 = 1 THEN 'empty transcription'
  WHEN doc_id % 4 = 2 THEN 'bad duration' END AS reason, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1)
SELECT reason, n, round(n * CAST(100 AS DOUBLE) / sum(n) OVER (), 4) AS percent, CAST(sum(n) OVER () AS BIGINT) AS total,
  CAST(sum(n) FILTER (reason IS NULL) OVER () AS BIGINT) AS valid,
  round(sum(n) FILTER (reason IS NULL) OVER () * CAST(100 AS DOUBLE) / sum(n) OVER (), 4) AS success_percent,
  CASE WHEN reason IS NULL THEN 0 ELSE n END AS n_written, reason IS NOT NULL AS has_files FROM c""",
)
def agg15_report(spark, d):
    """Every reason with its rows, and the same rows found in the error output."""
    checked = filters.validate_samples(flawed_records(spark, d), "/data")
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    writers.write_with_errors(checked, good, bad)
    report = stats.skip_report(checked, written=writers.read_errors(spark, bad, readers.MANIFEST))
    return rounded(report.withColumn("has_files", F.col("files") > 0).drop("files"))


@query(
    "agg16_estimated_hours",
    "SELECT lang AS language, coalesce(sum(n_chars) FILTER (doc_id % 2 = 0), 0) / CAST(15 AS DOUBLE) AS hours FROM documents GROUP BY lang",
)
def agg16(spark, d):
    """Every second entry of the registry has no estimate."""
    registry = table(spark, d, "documents").select(
        F.col("lang").alias("language"),
        F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("double")).alias("estimated_hours"),
    )
    return stats.estimated_hours(registry).withColumn("hours", F.col("hours") / 15.0)


def scalar_log(spark, d):
    return table(spark, d, "events").select(
        F.col("event_type").alias("tag"), F.col("event_id").alias("step"), "value"
    )


@query(
    "agg17_scalar_summary",
    "SELECT event_type AS tag, CAST(count(*) AS BIGINT) AS points, min(event_id) AS first_step, max(event_id) AS last_step, "
    "arg_max(value, event_id) AS latest_value, max(max(event_id)) OVER () AS max_step FROM events GROUP BY event_type",
)
def agg17(spark, d):
    return stats.scalar_summary(scalar_log(spark, d))


@query(
    "agg18_key_uniqueness",
    "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT user_id) AS BIGINT) AS distinct_keys, count(*) = count(DISTINCT user_id) AS is_unique FROM events",
)
def agg18(spark, d):
    return stats.key_uniqueness(table(spark, d, "events"), "user_id")


@query(
    "agg19_latest_by_number",
    "SELECT o_orderpriority, 'checkpoint-' || CAST(max(o_orderkey) AS VARCHAR) AS latest, max(o_orderkey) AS number FROM orders GROUP BY o_orderpriority",
)
def agg19(spark, d):
    name = F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string"))
    return stats.latest_by_number(table(spark, d, "orders"), name, ["o_orderpriority"])


# -------------------------------------------------------------------------------------------------- windows
@query(
    "win1_stratified_split",
    f"WITH {CORPUS} SELECT doc_id, source, {split_sql('source', 'doc_id', 0.95)} AS split FROM corpus",
)
def win1(spark, d):
    rows = corpus(spark, d).select("doc_id", "source")
    return ranks.stratified_split(rows, ["source"], ["doc_id"], 0.95, unique_key=True)


@query(
    "win2_speaker_split",
    f"SELECT s_suppkey, s_nationkey, {split_sql('s_nationkey', 's_suppkey', 0.9)} AS split FROM supplier",
)
def win2(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return ranks.stratified_split(rows, ["s_nationkey"], ["s_suppkey"], 0.9)


@query("win3_last_timestamp", f"WITH {TAGGED} SELECT doc_id, duration AS last_time FROM parsed")
def win3(spark, d):
    return tagged(spark, d).select("doc_id", X.marker_duration(F.col("segment_timestamp")).alias("last_time"))


@query(
    "win4_last_points",
    "SELECT tag, step, value, rank FROM (SELECT event_type AS tag, event_id AS step, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rank FROM events) WHERE rank <= 10",
)
def win4(spark, d):
    last = ranks.top_per_group(scalar_log(spark, d), 10, ["tag"], [F.desc("step")])
    return last.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "win5_word_runs",
    f"""WITH t AS (SELECT doc_id, unnest({sql_words('text')}) AS word, generate_subscripts({sql_words('text')}, 1) AS pos FROM documents),
f AS (SELECT *, regexp_replace(lower(word), '[^\\pL\\pN_]', '', 'g') IN ('the', 'and', 'der', 'que', 'of') AS listed FROM t),
g AS (SELECT *, CASE WHEN listed = lag(listed) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM f),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g)
SELECT doc_id, CAST(run AS BIGINT) AS run, bool_and(listed) AS is_english, string_agg(word, ' ' ORDER BY pos) AS text FROM h GROUP BY doc_id, run""",
)
def win5(spark, d):
    runs = table(spark, d, "documents").select(
        "doc_id",
        F.posexplode(L.word_runs(F.col("text"), ["the", "and", "der", "que", "of"])).alias("run", "part"),
    )
    return runs.select("doc_id", (F.col("run") + 1).cast("bigint").alias("run"), "part.is_english", "part.text")


@query(
    "win6_first_per_text",
    "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(trim(text, ' \n'))",
)
def win6(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return ranks.first_per_key(docs, joins.text_key(F.col("text")), ["doc_id"]).select("doc_id")


@query(
    "win7_share_of_total",
    "SELECT lang AS language, CAST(count(*) AS BIGINT) AS samples, round(count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER (), 4) AS share FROM documents GROUP BY lang",
)
def win7(spark, d):
    counts = corpus(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("samples"))
    return rounded(stats.with_share(counts))


@query(
    "win8_extremes",
    f"{COMPARED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY abs(delta) DESC, dataset, utterance_id) AS rank FROM compared WHERE verdict <> 'same') "
    "SELECT verdict, rank, round(delta, 6) AS delta FROM ranked WHERE rank <= 20",
)
def win8(spark, d):
    best = wer.extremes(compared(spark, d), 20, KEY)
    return best.select("verdict", F.col("rank").cast("bigint").alias("rank"), F.round("delta", 6).alias("delta"))


# ------------------------------------------------------------------------------------------ samples and limits
@query(
    "srt1_head_limit",
    "(SELECT doc_id, 'train' AS part FROM documents ORDER BY doc_id LIMIT 100) UNION ALL (SELECT doc_id, 'val' AS part FROM documents ORDER BY doc_id DESC LIMIT 10)",
)
def srt1(spark, d):
    """The first hundred rows, and a tenth of that from the validation side, which runs backwards."""
    docs = table(spark, d, "documents").select("doc_id")
    train, val = ranks.head_limit(docs, docs, 100, ["doc_id"], val_key=[F.desc("doc_id")])
    return train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))


@query("srt2_seeded_sample", f"SELECT doc_id FROM documents ORDER BY {draw_sql('doc_id', 7)} LIMIT 123")
def srt2(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return ranks.seeded_sample(docs, 123, ["doc_id"], seed=7, unique_key=True)


@query(
    "srt3_equal_quota",
    f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {draw_sql('doc_id')}) AS r FROM documents) WHERE r <= 210 // 20",
)
def srt3(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return ranks.equal_quota(docs, 210, 20, "source", ["doc_id"])


@query(
    "srt4_reservoir_pair",
    f"(SELECT doc_id, lang FROM documents WHERE lang = 'en' ORDER BY {draw_sql('doc_id')} LIMIT 30) UNION ALL "
    f"(SELECT doc_id, lang FROM documents WHERE lang <> 'en' ORDER BY {draw_sql('doc_id')} LIMIT 31)",
)
def srt4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return ranks.reservoir_pair(
        docs.where("lang = 'en'"), docs.where("lang <> 'en'"), 61, ["doc_id"], unique_key=True
    )


@query(
    "srt5_shuffle_positions",
    f"SELECT doc_id, row_number() OVER (ORDER BY {draw_sql('doc_id')}, doc_id) AS position FROM documents",
)
def srt5(spark, d):
    """The place of every row in the shuffled corpus; ``shuffle_rows`` sorts by the same draws."""
    return ranks.number_by_draw(table(spark, d, "documents").select("doc_id"), ["doc_id"], name="position")


@query("srt5_shuffle_rows", "SELECT doc_id, text FROM documents")
def srt5_rows(spark, d):
    return ranks.shuffle_rows(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"])


@query(
    "srt6_most_frequent",
    "SELECT token, CAST(count(*) AS BIGINT) AS freq FROM (SELECT unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS token FROM documents) GROUP BY token ORDER BY freq DESC, token LIMIT 12",
)
def srt6(spark, d):
    return vocab.most_frequent(vocab.char_frequency(table(spark, d, "documents")), 12)


@query(
    "srt7_work_shares",
    f"SELECT doc_id, (row_number() OVER (ORDER BY {draw_sql('doc_id')}, doc_id) - 1) % 7 AS share FROM documents",
)
def srt7(spark, d):
    return ranks.work_shares(table(spark, d, "documents").select("doc_id"), 7, ["doc_id"])


@query(
    "srt8_length_budget",
    f"WITH {CORPUS} SELECT doc_id FROM corpus WHERE duration <= 120 AND length(text) <= 1500",
)
def srt8(spark, d):
    return filters.length_budget(corpus(spark, d), 120.0, 1500).select("doc_id")


# ------------------------------------------------------------------------------------------------ set operations
@query(
    "set1_concatenate",
    "SELECT doc_id, text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark",
)
def set1(spark, d):
    items = table(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id")
    return joins.concatenate([table(spark, d, "documents").select("doc_id", "text", "lang"), items])


@query("set2_merge_manifests", "SELECT doc_id, lang FROM documents")
def set2(spark, d):
    """A language whose manifest is missing is left out."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    parts = [docs.where("lang = 'en'"), None, *[docs.where(F.col("lang") == c) for c in ("de", "es", "fr")]]
    return plan.merge_manifests(parts, ["doc_id"], seed=42)


@query(
    "set3_merge_batches",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS batch FROM documents",
)
def set3(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    first = store(docs.where("doc_id % 2 = 0").withColumn("batch", F.lit("first")), "batch")
    second = store(docs.where("doc_id % 2 = 1").withColumn("batch", F.lit("second")), "batch")
    return joins.concatenate([first, second])


@query(
    "set4_combined_vocabulary",
    """WITH c AS (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS token FROM documents) GROUP BY lang, token),
k AS (SELECT token, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS r FROM c)
SELECT token, CAST(sum(n) AS BIGINT) AS freq FROM c WHERE token IN (SELECT token FROM k WHERE r <= 4) GROUP BY token""",
)
def set4(spark, d):
    docs = table(spark, d, "documents")
    freqs = [vocab.char_frequency(docs.where(F.col("lang") == code)) for code in ("fr", "es", "de", "en")]
    return vocab.combined_vocabulary(freqs, [4, 4, 4, 4])


@query(
    "set5_keyword_hits",
    "SELECT doc_id, CAST(len(list_intersect(list_distinct(string_split_regex(lower(text), '\\s+')), ['der','die','que','los','les','und'])) AS INTEGER) AS hits FROM documents",
)
def set5(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", L.keyword_hits(F.col("text"), ["der", "die", "que", "los", "les", "und"]).alias("hits")
    )


@query(
    "set6_route_subsets",
    f"""WITH r AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'train' WHEN 'de' THEN 'test' END AS side FROM documents)
SELECT doc_id, CASE WHEN side = 'test' THEN side ELSE
  CASE WHEN row_number() OVER (PARTITION BY side ORDER BY {draw_sql('doc_id')}) <= floor(count(*) OVER (PARTITION BY side) * CAST(0.95 AS DOUBLE)) THEN 'train' ELSE 'val' END END AS split
FROM r WHERE side IS NOT NULL""",
)
def set6(spark, d):
    """Two training phases and a test set are declared, but no validation rows."""
    subset = (
        F.when(F.col("lang") == "en", "train_phase1")
        .when(F.col("lang") == "fr", "train_phase2")
        .when(F.col("lang") == "de", "test")
        .otherwise("other")
    )
    rows = table(spark, d, "documents").select("doc_id", subset.alias("subset"))
    return plan.route_subsets(rows, ["doc_id"]).select("doc_id", "split")


# ---------------------------------------------------------------------------------------------- benchmark run
@query(
    "score_benchmark",
    f"""{RUN}, u AS (SELECT utterance_id, dataset, {sql_compounds(sql_scoring_ms('reference'))} AS reference FROM utterances),
h AS (SELECT model, dataset, utterance_id, {sql_compounds(sql_scoring_ms('hypothesis'))} AS hypothesis FROM heard),
p AS (SELECT h.model, dataset, {sql_word_errors('u.reference', 'h.hypothesis')} AS errors, CAST(len({sql_words('u.reference')}) AS BIGINT) AS ref_words FROM h JOIN u USING (dataset, utterance_id))
SELECT model, dataset, CAST(count(*) AS BIGINT) AS samples, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(ref_words) AS BIGINT) AS ref_words,
  round(sum(errors) / CAST(sum(ref_words) AS DOUBLE), 6) AS wer FROM p GROUP BY model, dataset""",
)
def score_benchmark(spark, d):
    """Both sides normalised, every model against every test set."""
    utts = utterances(spark, d)
    scored = benchmark.score_benchmark(all_heard(utts), utts.drop("number"))
    long, _ = benchmark.summarize(scored, DATASETS)
    return long.withColumn("wer", F.round("wer", 6))


@query(
    "prepare_speakers",
    f"""WITH t AS (SELECT doc_id, source AS speaker, text, n_chars / CAST(150 AS DOUBLE) AS seconds FROM documents),
k AS (SELECT *, CAST(doc_id AS VARCHAR) || '.mp3' AS audio_filename FROM t
  WHERE trim(text, ' \n') <> '' AND length(trim(text, ' \n')) <= 1500 AND seconds BETWEEN 0.5 AND 15.0)
SELECT audio_filename, trim(text, ' \n') AS text, round(seconds, 3) AS duration, speaker,
  CAST(CASE speaker WHEN 'src3' THEN 0 WHEN 'src4' THEN 1 ELSE 2 END AS INTEGER) AS speaker_id,
  {split_sql('speaker', 'audio_filename', 0.95)} AS split FROM k""",
)
def prepare_speakers(spark, d):
    """Every source is a speaker; a third of the rows has no normalised text."""
    third = F.col("doc_id") % 3 == 0
    metadata = table(spark, d, "documents").select(
        F.col("source").alias("speaker"),
        F.col("text").alias("original"),
        F.when(third, "").otherwise(F.col("text")).alias("normalized"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".mp3")).alias("audio_filename"),
        (F.col("n_chars") / 150.0).alias("duration"),
    )
    return speakers.prepare_speakers(metadata, {"src3": 0, "src4": 1}, unique_key=True)


@query(
    "prepare_keyed_corpus",
    f"""SELECT doc_id, {SQL_ZH_DONE} AS text, round(n_chars / CAST(15 AS DOUBLE), 4) AS duration FROM documents
WHERE n_chars / CAST(15 AS DOUBLE) BETWEEN 0.1 AND 600 AND {SQL_ZH_DONE} <> ''""",
)
def prepare_keyed_corpus(spark, d):
    rows = corpus(spark, d).select("doc_id", zh_text(F.col("text")).alias("text"), "duration")
    return plan.prepare_keyed_corpus(rows, high=MAX_SECONDS)
