"""Whole runs: what they write is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.base import CORPUS, DATASETS, all_heard, corpus, query, sql_squeeze, sql_word_errors, sql_words, table, utterances
from contract.generation_queries import LANGUAGES, SENTENCE_TYPES, SHARE_TEMPLATES, SHARE_VALUES, TOPICS, _share_sql
from contract.operator_queries import RUN, draw_sql
from contract.text_queries import MIXED, SQL_CHINESE, SQL_ZH_DONE, sql_compounds, sql_scoring_ms, zh_text
from tuturan.functions import language as L
from tuturan.functions.expr import squeeze
from tuturan.plans import benchmark, corpus as plan, synthesis, vocabulary
from tuturan.session import scratch_path
from tuturan.sources import readers, writers


@query(
    "run_benchmark",
    f"""{RUN}, u AS (SELECT utterance_id, dataset, {sql_compounds(sql_scoring_ms('reference'))} AS reference FROM utterances),
h AS (SELECT model, dataset, utterance_id, {sql_compounds(sql_scoring_ms('hypothesis'))} AS hypothesis FROM heard),
p AS (SELECT h.model, dataset, {sql_word_errors('u.reference', 'h.hypothesis')} AS errors, CAST(len({sql_words('u.reference')}) AS BIGINT) AS ref_words FROM h JOIN u USING (dataset, utterance_id))
SELECT model, dataset, CAST(count(*) AS BIGINT) AS num_samples, round(sum(errors) / CAST(sum(ref_words) AS DOUBLE), 6) AS overall_wer,
  CAST(count(*) AS BIGINT) AS utterances, round(sum(errors / CAST(nullif(ref_words, 0) AS DOUBLE)), 4) AS wer_of_utterances,
  round(sum(errors) / CAST(sum(ref_words) AS DOUBLE), 6) AS cell FROM p GROUP BY model, dataset""",
)
def run_benchmark(spark, d):
    """Totals, utterance files and the summary table of three models on three test sets."""
    utts, output = utterances(spark, d), scratch_path(spark, "benchmark")
    totals = benchmark.run_benchmark(all_heard(utts), utts.drop("number"), output, DATASETS)
    schema = "utterance_id string, groundtruth string, predicted string, wer double, model string, dataset string"
    files = spark.read.schema(schema).json(f"{output}/utterances").groupBy("model", "dataset").agg(
        F.count(F.lit(1)).alias("utterances"), F.round(F.sum("wer"), 4).alias("wer_of_utterances")
    )
    cells = ", ".join(f"{x} double" for x in DATASETS)
    summary = spark.read.option("header", "true").schema(f"model string, {cells}").csv(f"{output}/summary")
    cell = summary.unpivot("model", DATASETS, "dataset", "cell").withColumn("cell", F.round("cell", 6))
    key = ["model", "dataset"]
    return totals.withColumn("overall_wer", F.round("overall_wer", 6)).join(files, key).join(cell, key)


SUBSETS = {"en": "train_phase1", "fr": "train_phase2", "es": "test", "de": "unused"}
MOST = 400  # of a subset


def keyed_run(spark, d):
    """Four subset folders, of which three and one that is not there are asked for."""
    folder, output = scratch_path(spark, "keyed"), scratch_path(spark, "corpus")
    docs = table(spark, d, "documents")
    key, number = F.concat(F.lit("utt"), F.col("doc_id").cast("string")), F.col("doc_id").cast("string")
    line = F.when(F.col("doc_id") % 9 == 0, key).otherwise(F.concat_ws(" ", key, squeeze(zh_text(F.col("text")))))
    for lang, subset in SUBSETS.items():
        own = docs.where(F.col("lang") == lang)
        own.select(line.alias("value")).write.text(f"{folder}/{subset}/text")
        wav = F.concat(key, F.lit(" wav/"), number, F.lit(".wav"))
        own.where("doc_id % 11 <> 0").select(wav.alias("value")).write.text(f"{folder}/{subset}/wav.scp")
    audio = docs.where("doc_id % 13 <> 0").select(
        F.concat(F.lit("/data/wav/"), number, F.lit(".wav")).alias("path"),
        F.when(F.col("doc_id") % 17 != 0, F.col("n_chars") / 15.0).alias("duration"),
    )
    statistics = plan.build_keyed_corpus(
        spark, folder, output, "/data", audio, ["train_phase1", "train_phase2", "dev_phase1", "test"], high=600.0, max_samples=MOST
    )
    return output, statistics


KEYED = f"""u AS (SELECT *, 'utt' || CAST(doc_id AS VARCHAR) AS utt_id, n_chars / CAST(15 AS DOUBLE) AS seconds,
  CASE lang WHEN 'en' THEN 'train_phase1' WHEN 'fr' THEN 'train_phase2' WHEN 'es' THEN 'test' END AS subset FROM documents WHERE doc_id % 11 <> 0),
l AS (SELECT *, {SQL_ZH_DONE} AS done FROM u WHERE subset IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY subset ORDER BY {draw_sql('utt_id')}) <= {MOST}),
k AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'missing audio' WHEN doc_id % 17 = 0 THEN 'unreadable audio' WHEN doc_id % 9 = 0 THEN 'empty text'
  WHEN seconds NOT BETWEEN 0.1 AND 600 THEN 'duration' WHEN done = '' THEN 'empty after normalisation' END AS reason FROM l)"""


@query(
    "build_keyed_corpus",
    f"""WITH {KEYED}, r AS (SELECT *, CASE WHEN subset = 'test' THEN 'test' ELSE 'train' END AS side FROM k WHERE reason IS NULL),
s AS (SELECT *, CASE WHEN side = 'train' AND row_number() OVER (PARTITION BY side ORDER BY {draw_sql('utt_id')}) > floor(count(*) OVER (PARTITION BY side) * CAST(0.95 AS DOUBLE))
  THEN 'val' ELSE side END AS split FROM r)
SELECT split, '/data/wav/' || CAST(doc_id AS VARCHAR) || '.wav' AS audio_filepath, done AS text, round(seconds, 4) AS duration,
  CAST(count(*) OVER (PARTITION BY split) AS BIGINT) AS samples FROM s""",
)
def build_keyed_corpus(spark, d):
    """Manifests read back, beside the rows that the statistics count for their split."""
    output, statistics = keyed_run(spark, d)
    counted = statistics.groupBy("split").agg(F.sum("samples").alias("samples"))
    schema = readers.MANIFEST
    sides = [readers.read_manifest(spark, f"{output}/{s}", schema).withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    whole = sides[0].unionByName(sides[1]).unionByName(sides[2])
    return whole.join(counted, "split").select("split", "audio_filepath", "text", "duration", "samples")


@query(
    "build_keyed_corpus_skipped",
    f"WITH {KEYED} SELECT subset, reason, CAST(count(*) AS BIGINT) AS n FROM k WHERE reason IS NOT NULL GROUP BY subset, reason",
)
def build_keyed_corpus_skipped(spark, d):
    output, _ = keyed_run(spark, d)
    return spark.read.schema("subset string, reason string, n bigint").json(f"{output}/skipped")


def _chars_sql(half: int) -> str:
    return (
        "SELECT token, count(*) AS freq FROM (SELECT unnest(string_split(text, '')) AS token FROM documents "
        f"WHERE doc_id % 2 = {half}) WHERE unicode(token) > 127 AND token NOT IN ('é', 'ü') GROUP BY token"
    )


@query(
    "build_vocabulary",
    f"""WITH a AS ({_chars_sql(0)}), b AS ({_chars_sql(1)}), kept AS (
  (SELECT token FROM a ORDER BY freq DESC, token LIMIT 5) UNION (SELECT token FROM b ORDER BY freq DESC, token LIMIT 8)),
f AS (SELECT token, sum(freq) AS freq FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE token IN (SELECT token FROM kept) GROUP BY token)
SELECT token, round(CAST(-1000 AS DOUBLE) - (row_number() OVER (ORDER BY freq DESC, token) - 1) * CAST(0.001 AS DOUBLE), 6) AS score
FROM f ORDER BY freq DESC, token LIMIT 7""",
)
def build_vocabulary(spark, d):
    """Two manifests, each with its cap, two known characters and a total cap."""
    specs = []
    for half, cap in ((0, 5), (1, 8)):
        path = scratch_path(spark, "manifest")
        rows = corpus(spark, d).where(F.col("doc_id") % 2 == half).drop("language")
        writers.write_manifest(writers.manifest_rows(rows, "/data"), path)
        specs.append(f"{path}:{cap}")
    known = spark.createDataFrame([("é",), ("ü",)], "token string")
    return vocabulary.build_vocabulary(spark, specs, scratch_path(spark, "vocabulary"), known, total=7)


SENTENCES = 100
FEW = 7  # sentences a generator gives of a speaker's English


@query(
    "generation_run",
    f"""WITH s AS ({_share_sql(SENTENCES)}), t AS (SELECT s_suppkey, language, count(*) AS planned,
  count(*) FILTER (language <> 'english' OR sample > {FEW}) AS from_templates,
  sum(word_count) FILTER (language <> 'english' OR sample > {FEW}) AS words FROM s GROUP BY s_suppkey, language)
SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, language, CAST(planned AS BIGINT) AS planned,
  CAST(CASE language WHEN 'english' THEN {FEW} ELSE 0 END AS BIGINT) AS generated, CAST(from_templates AS BIGINT) AS from_templates,
  CAST(words + CASE language WHEN 'english' THEN {2 * FEW} ELSE 0 END AS BIGINT) AS words FROM t""",
)
def generation_run(spark, d):
    """A generator that only knows English greetings; templates give the rest of every quota."""

    def make(wanted):
        known = wanted.where("language = 'english' AND topic = 'greetings_closings'")
        return known.drop("n").withColumn("text", F.concat(F.lit("hello "), "sentence_type"))

    speakers = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("s_suppkey"))
    return synthesis.generation_run(
        speakers, scratch_path(spark, "sentences"), SENTENCES, LANGUAGES, TOPICS, SENTENCE_TYPES,
        SHARE_TEMPLATES, SHARE_VALUES, make, "s_suppkey",
    )


@query(
    "prepare_test_set",
    f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)
SELECT 'docs_' || lpad(CAST(n AS VARCHAR), 6, '0') AS utterance_id, 'audio/docs_' || lpad(CAST(n AS VARCHAR), 6, '0') || '.wav' AS path,
  {sql_squeeze('replace(text, chr(34), chr(32))')} AS sentence, CAST(CAST(n_chars * 125 AS DECIMAL(18,0)) / 1000 AS DECIMAL(18,3)) || '' AS duration,
  (SELECT CAST(count(*) FILTER (doc_id % 10 < 4) AS BIGINT) FROM documents) AS skipped FROM r WHERE doc_id % 10 >= 4""",
)
def prepare_test_set(spark, d):
    """Text and audio under other names; four rows of ten lack something."""
    digit = F.col("doc_id") % 10
    rows = table(spark, d, "documents").select(
        "doc_id",
        F.when(digit != 0, squeeze(F.replace("text", F.lit('"'), F.lit(" ")))).alias("transcript"),
        F.when(digit != 1, "a.wav").alias("speech"),
        F.when(digit == 3, 0.05).when(digit != 2, F.col("n_chars") / 8.0).alias("seconds"),
    )
    output = scratch_path(spark, "test-set")
    report = benchmark.prepare_test_set(rows, output, "docs", "doc_id", "seconds")
    skipped = report.where("reason IS NOT NULL").agg(F.sum("n")).scalar()
    test = readers.read_benchmark(spark, f"{output}/test")
    return test.select("utterance_id", "path", "sentence", "duration").withColumn("skipped", skipped)


HITS = (
    "len(list_intersect(list_distinct(string_split_regex(lower(text), '\\s+')), "
    + "[" + ", ".join(f"'{w}'" for w in L.MALAY_KEYWORDS) + "]))"
)


@query(
    "tagging_run",
    f"""WITH t AS (SELECT {MIXED} AS text FROM documents), l AS (SELECT CASE
  WHEN {SQL_CHINESE} / CAST(greatest(length(replace(text, ' ', '')), 1) AS DOUBLE) > 0.3 THEN 'zh' WHEN {HITS} >= 2 THEN 'ms' ELSE 'en' END AS lang FROM t)
SELECT lang, CAST(count(*) AS BIGINT) AS samples, round(count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER (), 4) AS share,
  CAST(count(*) AS BIGINT) AS tagged FROM l GROUP BY lang""",
)
def tagging_run(spark, d):
    """Counts as written, and the texts of the written manifest that begin with their tag."""
    mixed = F.when(F.col("doc_id") % 5 == 0, F.translate(F.col("text"), "aeioun", "我你他的是不")).otherwise(F.col("text"))
    path, output = scratch_path(spark, "manifest"), scratch_path(spark, "tagged")
    rows = corpus(spark, d).drop("language").withColumn("text", mixed)
    writers.write_manifest(writers.manifest_rows(rows, "/data"), path)
    counts = synthesis.tagging_run(spark, path, output)
    tagged = readers.read_manifest(spark, f"{output}/manifest", readers.MANIFEST + ", lang string")
    begins = tagged.where(F.startswith("text", F.concat(F.lit("<|"), "lang", F.lit("|> "))))
    by_lang = begins.groupBy("lang").agg(F.count(F.lit(1)).alias("tagged"))
    return counts.withColumn("share", F.round("share", 4)).join(by_lang, "lang", "left")
