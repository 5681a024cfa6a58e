"""Readers and writers: table rows are written in the format first, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.base import CORPUS, TAGGED, corpus, query, sql_squeeze, table, tagged
from tuturan.functions.expr import squeeze
from tuturan.operators import filters
from tuturan.session import scratch_path
from tuturan.sources import inventory, readers, rejects, shards, writers

SOURCE_OF_FILE = "concat(source, '-00000-of-00001.parquet')"


@query(
    "src1_tagged_corpus",
    f"WITH {TAGGED} SELECT audio_filename, text, duration, source, language FROM parsed WHERE text <> ''",
)
def src1(spark, d):
    """Shard names come from the table, a tenth of the texts is missing or blank and must go."""
    raw = tagged(spark, d).withColumn("file_name", F.expr(SOURCE_OF_FILE)).drop("source")
    blank = raw.select(
        "doc_id",
        F.col("audio_filename"),
        F.when(F.col("doc_id") % 2 == 0, "<|ms|> <|0.10|>").alias("segment_timestamp"),
        "file_name",
    ).where(F.col("doc_id") % 10 == 0)
    named = raw.unionByName(blank).withColumn("source", readers.shard_source(F.col("file_name")))
    return readers.tagged_corpus(named)


@query(
    "src2_pick_sources",
    f"WITH {CORPUS} SELECT doc_id, source FROM corpus WHERE source IN ('src1', 'src7', 'src19')",
)
def src2(spark, d):
    return readers.pick_sources(corpus(spark, d), ["src1", "src7", "src19"]).select("doc_id", "source")


SHARDS = 3


def named_shards(spark, rows, name):
    """A folder of shard sets, three shards for each value of a column, several files each.

    A row of nulls, which readers drop, keeps a shard of a small corpus from being empty.
    """
    path = scratch_path(spark, "shards")
    placed = rows.withColumn("_number", F.pmod(F.xxhash64(*rows.columns), F.lit(SHARDS)))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != name]
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARDS - 1).cast("long")))
    whole = placed.unionByName(rows.select(name).distinct().select(name, *nothing, every.alias("_number")))
    number = F.lpad(F.col("_number").cast("string"), 5, "0")
    entry = F.concat(F.col(name), F.lit("-"), number, F.lit(f"-of-{SHARDS:05}.parquet"))
    salt = F.pmod(F.hash(*rows.columns), F.lit(2))
    dealt = whole.withColumn("entry", entry).withColumn("salt", salt).repartition(8, "entry", "salt")
    dealt.drop(name, "_number", "salt").write.partitionBy("entry").parquet(path)
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in files.listStatus(top):  # three for each of a few corpora
        value = folder.getPath().getName().partition("=")[2]
        if value and not files.rename(folder.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path}/{value}")):
            raise OSError(f"{value} could not be named")
    return path


TAGGED_ROWS = "SELECT source, audio_filename, text, duration, language FROM parsed WHERE text <> ''"


@query("src1_read_tagged", f"WITH {TAGGED} {TAGGED_ROWS}")
def src1_files(spark, d):
    """All shards of a folder, three for each corpus, of several files each."""
    rows = tagged(spark, d).select("audio_filename", "segment_timestamp", F.col("source").alias("corpus"))
    return readers.read_tagged(spark, named_shards(spark, rows, "corpus")).select(
        "source", "audio_filename", "text", "duration", "language"
    )


@query("src2_read_chosen", f"WITH {TAGGED} {TAGGED_ROWS} AND source IN ('src1', 'src12')")
def src2_files(spark, d):
    """Named corpora only; ``src1`` does not take ``src10`` and its like with it."""
    rows = tagged(spark, d).select("audio_filename", "segment_timestamp", F.col("source").alias("corpus"))
    folder = named_shards(spark, rows, "corpus")
    return readers.read_tagged(spark, folder, ["src1", "src12"]).select(
        "source", "audio_filename", "text", "duration", "language"
    )


def paired_shards(spark, d):
    """Every second corpus has a word shard, which knows two of three files."""
    rows = tagged(spark, d).withColumn("new_text", F.col("segment_timestamp"))
    even = F.substring("source", 4, 9).cast("int") % 2 == 0
    segments = rows.withColumn("shard", F.concat("source", F.when(even, "_segments").otherwise("")))
    words = rows.where(even & (F.col("doc_id") % 3 != 0)).withColumn("shard", F.concat("source", F.lit("_words")))
    both = segments.unionByName(words).select("audio_filename", "new_text", "shard")
    return named_shards(spark, both, "shard")


@query(
    "src3_read_paired",
    f"""WITH {TAGGED} SELECT source, audio_filename, text,
  CASE WHEN doc_id % 3 <> 0 AND CAST(substr(source, 4) AS INTEGER) % 2 = 0 THEN duration ELSE 0 END AS duration
FROM parsed WHERE text <> ''""",
)
def src3_files(spark, d):
    paired = readers.read_paired(spark, paired_shards(spark, d))
    return paired.select("source", "audio_filename", "text", "duration")


SHARD_NAMES = (
    "CASE CAST(substring(source, 4) AS INT) % 6 WHEN 0 THEN array(concat(source, '_segments'), concat(source, '_words')) "
    "WHEN 1 THEN array(concat(source, '_segment_timestamp'), concat(source, '_word_timestamp')) "
    "WHEN 2 THEN array(source) WHEN 3 THEN array(concat(source, '_noise')) "
    "WHEN 4 THEN array(concat(source, '_words')) ELSE array(concat(source, '_noise_segments')) END"
)


@query(
    "src3_pair_shards",
    """WITH s AS (SELECT DISTINCT source, CAST(substring(source, 4) AS INTEGER) % 6 AS k FROM documents)
SELECT CASE WHEN k = 5 THEN source || '_noise' ELSE source END AS base,
  CASE k WHEN 0 THEN source || '_segments' WHEN 1 THEN source || '_segment_timestamp' WHEN 2 THEN source
    ELSE source || '_noise_segments' END || '-00000-of-00001.parquet' AS segments_file,
  CASE k WHEN 0 THEN source || '_words' WHEN 1 THEN source || '_word_timestamp' END || '-00000-of-00001.parquet' AS words_file
FROM s WHERE k IN (0, 1, 2, 5)""",
)
def src3(spark, d):
    names = (
        table(spark, d, "documents")
        .select("source")
        .distinct()
        .select(F.explode(F.expr(SHARD_NAMES)).alias("name"))
        .select(F.concat("name", F.lit("-00000-of-00001.parquet")).alias("file_name"))
    )
    files = shards.with_shard(names.withColumnRenamed("file_name", "entry")).withColumn("length", F.lit(1))
    first = lambda side: F.get(side, F.lit(0)).alias(f"{side}_file")
    return shards.pair_sets(shards.shard_sets(files)).select("base", first("segments"), first("words"))


@query(
    "src4_json_records",
    "SELECT c_name AS person, 'teks ' || c_name AS text, c_custkey AS index, CAST(c_acctbal AS DOUBLE) AS duration, "
    "c_name || '.wav' AS audio_path FROM customer",
)
def src4(spark, d):
    """Five hundred customers become one file, wrapped in ``results`` or a bare list."""
    item = F.struct(
        F.concat(F.lit("teks "), "c_name").alias("text"),
        F.col("c_name").alias("person"),
        F.concat("c_name", F.lit(".wav")).alias("audio_path"),
        F.col("c_custkey").alias("index"),
        F.col("c_acctbal").alias("duration"),
    )
    part = F.floor(F.col("c_custkey") / 500)
    lists = table(spark, d, "customer").groupBy(part.alias("part")).agg(F.collect_list(item).alias("results"))
    value = F.when(F.col("part") % 2 == 0, F.to_json(F.struct("results"))).otherwise(F.to_json("results"))
    path = scratch_path(spark, "records")
    lists.select(value.alias("value"), "part").write.partitionBy("part").text(path)
    return readers.read_json_records(spark, path).select("person", "text", "index", "duration", "audio_path")


@query(
    "src5_manifest",
    f"WITH {CORPUS} SELECT audio_filename AS audio_filepath, text, duration FROM corpus",
)
def src5(spark, d):
    """Manifest lines with blank and broken lines in between."""
    rows = corpus(spark, d).select(F.col("audio_filename").alias("audio_filepath"), "text", "duration")
    lines = rows.select(
        F.concat(
            F.to_json(F.struct("*")),
            F.when(F.col("duration") > 100, "\n\n{broken").otherwise(""),
        ).alias("value")
    )
    path = scratch_path(spark, "manifest")
    lines.write.text(path)
    return readers.read_manifest(spark, path)


BROKEN = {1: "{broken", 2: '{"audio_filepath": "x", "duration": "long"}', 3: "12"}


@query(
    "src5_rejects",
    """SELECT source AS folder, CASE doc_id % 7 WHEN 2 THEN 'value of another type' ELSE 'not JSON' END AS reason,
  CASE doc_id % 7 WHEN 1 THEN '{broken' WHEN 2 THEN '{"audio_filepath": "x", "duration": "long"}' ELSE '12' END AS record,
  CAST(count(*) AS BIGINT) AS n, CAST(NULL AS BIGINT) AS valid FROM documents WHERE doc_id % 7 IN (1, 2, 3) GROUP BY ALL
UNION ALL SELECT source, NULL, NULL, NULL, CAST(count(*) AS BIGINT) FROM documents GROUP BY source""",
)
def src5_rejects(spark, d):
    """Every document has a good line; three of seven have a broken one after it."""
    rows = corpus(spark, d)
    good = F.to_json(F.struct(F.col("audio_filename").alias("audio_filepath"), "text", "duration"))
    broken = F.lit(None).cast("string")
    for k, line in BROKEN.items():
        broken = F.when(F.col("doc_id") % 7 == k, line).otherwise(broken)
    path = scratch_path(spark, "manifest")
    lines = rows.select(F.concat_ws("\n", good, broken).alias("value"), "source")
    lines.write.partitionBy("source").text(path)
    checked = rejects.checked_json(spark, path, readers.MANIFEST)
    out, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    counted = rejects.write_checked(checked, out, bad)
    read = spark.read.schema("file string, reason string, record string").json(bad)
    folder = F.regexp_extract("file", "source=([^/]+)/", 1).alias("folder")
    by_record = read.groupBy(folder, "reason", "record").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(folder, "reason").agg(F.sum("n").alias("n_of_reason"))
    told = by_record.join(totals, ["folder", "reason"]).withColumn("valid", F.lit(None).cast("bigint"))
    valid = readers.read_manifest(spark, out, readers.MANIFEST + ", source string").groupBy(F.col("source").alias("folder")).agg(F.count(F.lit(1)).alias("valid"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return told.select("folder", "reason", "record", "n", "valid").unionByName(
        valid.select("folder", none("string", "reason"), none("string", "record"), none("bigint", "n"), "valid")
    )


@query(
    "src4_csv_records",
    "SELECT c_name AS person, c_mktsegment AS text, c_custkey AS index, c_acctbal AS duration FROM customer WHERE c_custkey % 10 <> 3",
)
def src4_csv(spark, d):
    """Typed records; every tenth row has a word for its number and is left out."""
    rows = table(spark, d, "customer").select(
        F.col("c_name").alias("person"),
        F.col("c_mktsegment").alias("text"),
        F.when(F.col("c_custkey") % 10 == 3, "none").otherwise(F.col("c_custkey").cast("string")).alias("index"),
        F.col("c_acctbal").alias("duration"),
    )
    path = scratch_path(spark, "records")
    rows.write.option("header", "true").csv(path)
    fields = {"person": "string", "text": "string", "index": "bigint", "duration": "double"}
    return readers.read_csv_records(spark, path, fields)


def keyed_files(spark, d):
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("utt"), F.col("doc_id").cast("string"))
    line = F.concat(name, F.lit(" "), squeeze(F.col("text")))
    text = F.when(F.col("doc_id") % 9 == 0, name).when(
        F.col("doc_id") % 7 == 0, F.concat(name, F.lit(" earlier line\n"), line)
    ).otherwise(line)
    wav = F.when(F.col("doc_id") % 5 == 0, name).otherwise(
        F.concat(name, F.lit("   wav/"), F.col("doc_id").cast("string"), F.lit(".wav\n"))
    )
    texts, wavs = scratch_path(spark, "text"), scratch_path(spark, "wav")
    docs.select(text.alias("value")).write.text(texts)
    docs.where("doc_id % 11 <> 0").select(wav.alias("value")).write.text(wavs)
    return texts, wavs


@query(
    "src6_keyed_text",
    f"SELECT 'utt' || CAST(doc_id AS VARCHAR) AS utt_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE {sql_squeeze('text')} END AS text "
    "FROM documents",
)
def src6(spark, d):
    return readers.read_transcripts(spark, keyed_files(spark, d)[0])


@query(
    "src7_benchmark_table",
    f"SELECT CAST(doc_id AS VARCHAR) AS utterance_id, 'audio/' || CAST(doc_id AS VARCHAR) || '.wav' AS path, "
    f"{sql_squeeze('replace(text, chr(34), chr(32))')} AS sentence FROM documents",
)
def src7(spark, d):
    path = scratch_path(spark, "benchmark")
    rows = table(spark, d, "documents").select(
        F.lit("old id").alias("utterance_id"),
        F.concat(F.lit("audio/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"),
        squeeze(F.replace("text", F.lit('"'), F.lit(" "))).alias("sentence"),
        (F.col("n_chars") / 15.0).alias("duration"),
    )
    writers.write_benchmark(rows, path)
    return readers.read_benchmark(spark, path).select("utterance_id", "path", "sentence")


@query(
    "src8_hypothesis_files",
    "SELECT CAST(item_id AS VARCHAR) AS utterance_id, lower(text) AS hypothesis FROM benchmark",
)
def src8(spark, d):
    """One JSON file per benchmark item; the folder name carries the id."""
    path = scratch_path(spark, "hypotheses")
    items = table(spark, d, "benchmark").select(
        "item_id", F.col("text"), F.lower("text").alias("text_norm")
    )
    items.repartition("item_id").write.partitionBy("item_id").json(path)
    return readers.read_hypotheses(spark, path, "item_id")


@query(
    "src9_conversations",
    """WITH c AS (SELECT conv_id, max(CASE WHEN turn = 1 THEN trim(text, ' \n') END) AS sentence, count(*) AS turns,
  max(CASE WHEN turn = 0 THEN length(text) END) AS chars FROM conversations GROUP BY conv_id)
SELECT 'CONV_' || CAST(conv_id AS VARCHAR) AS utterance_id, 'audio/CONV_' || CAST(conv_id AS VARCHAR) || '.wav' AS path,
  sentence, CAST(chars AS DOUBLE) / CAST(4 AS DOUBLE) AS duration FROM c WHERE turns >= 2 AND sentence <> ''""",
)
def src9(spark, d):
    turn = F.struct(
        "turn",
        "text",
        F.struct(F.lit(1.5).alias("start_time"), (F.length("text") / 4.0 + 1.5).alias("end_time")).alias("metadata"),
    )
    convs = (
        table(spark, d, "conversations")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        .select(
            F.concat(F.lit("CONV_"), F.col("conv_id").cast("string")).alias("uid"),
            F.transform("turns", lambda t: F.struct(t["text"].alias("text"), t["metadata"].alias("metadata"))).alias("conversation"),
        )
    )
    path = scratch_path(spark, "conversations")
    convs.write.json(path)
    return readers.read_conversations(spark, path)


@query(
    "src10_first_filled",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN lang ELSE text END AS chosen, "
    "'transcript' AS text_column FROM documents",
)
def src10(spark, d):
    third = F.col("doc_id") % 3
    rows = table(spark, d, "documents").select(
        "doc_id",
        F.when(third == 0, F.col("source")).alias("audio_path"),
        F.when(third == 1, F.col("lang")).otherwise("").alias("audio_filepath"),
        F.col("text").alias("transcript"),
    )
    name = filters.first_present(rows.columns, ["TEXT", "text", "Text", "transcript", "sentence"])
    chosen = filters.first_filled(rows, ["audio_path", "audio_filepath", "path", name])
    return rows.select("doc_id", chosen.alias("chosen"), F.lit(name).alias("text_column"))


@query(
    "src11_audio_inventory",
    "SELECT source AS folder, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source",
)
def src11(spark, d):
    """Folders of text files stand in for audio: every source is a folder with its files."""
    path = scratch_path(spark, "inventory")
    docs = table(spark, d, "documents")
    docs.select("source", F.col("doc_id").cast("string").alias("value")).repartition("source").write.partitionBy(
        "source"
    ).text(path)
    files = readers.audio_inventory(spark, path, "*.txt").withColumn(
        "folder", F.regexp_extract("path", "source=([^/]+)/", 1)
    )
    # A file holds one line per document; its size tells the rest.
    lines = spark.read.text(path).groupBy(F.col("source").alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    return lines.join(files.select("folder").distinct(), "folder", "left_semi")


@query(
    "src11_listed_files",
    """SELECT source AS folder, CAST(doc_id % 3 AS VARCHAR) AS part, CAST(sum(length(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) AS bytes
FROM documents GROUP BY ALL""",
)
def src11_sizes(spark, d):
    """Folders in folders, listed by the executors; hidden names and other endings do not count."""
    path = scratch_path(spark, "inventory")
    rows = table(spark, d, "documents").select(
        "source", (F.col("doc_id") % 3).alias("part"), F.col("doc_id").cast("string").alias("value")
    )
    rows.repartition(4, "source", "part").write.partitionBy("source", "part").text(path)
    rows.select("source", "part", "value").write.mode("append").partitionBy("source", "part").json(path)
    place = lambda k: F.regexp_extract("path", rf"{k}=([^/]+)/", 1)
    listed = inventory.list_files(spark, path, "part-*.{txt,wav}")
    return listed.groupBy(place("source").alias("folder"), place("part").alias("part")).agg(
        F.sum("length").alias("bytes")
    )


@query(
    "src13_templates",
    "SELECT p_type AS category, p_name AS template FROM (SELECT DISTINCT p_type, p_name FROM part)",
)
def src13(spark, d):
    """Category files of two hundred parts each; names repeated between files count once."""
    chunk = F.floor(F.col("p_partkey") / 200).alias("chunk")
    listed = (
        table(spark, d, "part")
        .groupBy(chunk, "p_type")
        .agg(F.sort_array(F.collect_set("p_name")).alias("names"))
        .groupBy("chunk")
        .agg(F.map_from_entries(F.collect_list(F.struct("p_type", "names"))).alias("categories"))
    )
    path = scratch_path(spark, "templates")
    listed.write.partitionBy("chunk").json(path)
    return readers.read_templates(spark, path).select("category", "template").distinct()


@query(
    "src14_dictionary",
    "SELECT lower(c_name) AS word, c_mktsegment || ' ' || CAST(c_nationkey AS VARCHAR) AS phonemes FROM customer",
)
def src14(spark, d):
    entries = table(spark, d, "customer").select(
        F.lower("c_name").alias("word"),
        F.concat("c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string")).alias("phonemes"),
    )
    path = scratch_path(spark, "dictionary")
    writers.write_dictionary(entries, path)
    return readers.read_dictionary(spark, path)


@query(
    "src14_vocabulary",
    "SELECT c_name AS token, c_acctbal AS score FROM customer",
)
def src14_vocabulary(spark, d):
    path = scratch_path(spark, "vocabulary")
    table(spark, d, "customer").select(
        F.concat("c_name", F.lit("\t"), F.col("c_acctbal").cast("string")).alias("value")
    ).write.text(path)
    return readers.read_vocabulary(spark, path)


@query(
    "src15_folder_audit",
    "SELECT source AS folder, CAST(count(*) AS BIGINT) AS files, bool_or(false) OR source IN "
    "(SELECT d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1) AS present "
    "FROM documents GROUP BY source",
)
def src15(spark, d):
    """A folder is there when one of its documents is labelled toxic."""
    labels = table(spark, d, "labels").where("toxic = 1")
    found = table(spark, d, "documents").join(labels, "doc_id", "left_semi").select(F.col("source").alias("folder"))
    return readers.folder_audit(corpus(spark, d), found)


# ----------------------------------------------------------------------------------------------------- sinks
@query(
    "snk1_manifest",
    f"WITH {CORPUS} SELECT '/data/audio/' || audio_filename AS audio_filepath, text, duration FROM corpus",
)
def snk1(spark, d):
    path = scratch_path(spark, "manifest")
    writers.write_manifest(writers.manifest_rows(corpus(spark, d).drop("language"), "/data/audio"), path)
    return readers.read_manifest(spark, path)


@query(
    "snk2_benchmark_rows",
    "SELECT CAST(doc_id AS VARCHAR) AS utterance_id, 'audio/' || CAST(doc_id AS VARCHAR) AS path, text AS sentence, "
    "CAST(CAST(n_chars * 125 AS DECIMAL(18,0)) / 1000 AS DECIMAL(18,3)) || '' AS duration FROM documents",
)
def snk2(spark, d):
    key = F.col("doc_id").cast("string")
    rows = table(spark, d, "documents").select(
        key.alias("utterance_id"),
        F.concat(F.lit("audio/"), key).alias("path"),
        F.col("text").alias("sentence"),
        (F.col("n_chars") / 8.0).alias("duration"),
    )
    return writers.benchmark_rows(rows, 3)


@query(
    "snk3_pipe_metadata",
    f"SELECT CAST(doc_id AS VARCHAR) || '|' || replace({sql_squeeze('text')}, '|', ' ') || '|' || source AS value FROM documents",
)
def snk3(spark, d):
    path = scratch_path(spark, "metadata")
    rows = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("file"), squeeze(F.col("text")).alias("text"), "source"
    )
    writers.write_pipe_metadata(rows, path, ["file", "text", "source"])
    return spark.read.text(path)


@query(
    "snk4_error_output",
    "SELECT CASE WHEN doc_id % 4 = 0 THEN 'missing audio path' WHEN doc_id % 4 = 1 THEN 'empty transcription' "
    "WHEN doc_id % 4 = 2 THEN 'bad duration' ELSE 'valid' END AS error, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1",
)
def snk4(spark, d):
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    writers.write_with_errors(filters.validate_samples(flawed_records(spark, d), "/data"), good, bad)
    valid = spark.read.schema(readers.MANIFEST).json(good).agg(F.count(F.lit(1)).alias("n"))
    broken = spark.read.schema(readers.MANIFEST + ", error string").json(bad)
    return valid.select(F.lit("valid").alias("error"), "n").unionByName(
        broken.groupBy("error").agg(F.count(F.lit(1)).alias("n"))
    )


def flawed_records(spark, d):
    """Records with every kind of flaw, chosen by the document number."""
    kind = F.col("doc_id") % 4
    return table(spark, d, "documents").select(
        "doc_id",
        F.when(kind != 0, F.concat(F.col("doc_id").cast("string"), F.lit(".wav"))).alias("audio_path"),
        F.when(kind == 1, "  ").otherwise(F.col("text")).alias("transcription"),
        F.when(kind == 2, F.lit("0")).otherwise((F.col("n_chars") / 15.0).cast("string")).alias("duration"),
    )


@query(
    "snk5_dictionary_lines",
    "SELECT upper(c_name) || ' ' || lower(c_mktsegment) AS value FROM customer",
)
def snk5(spark, d):
    path = scratch_path(spark, "dictionary")
    entries = table(spark, d, "customer").select(
        F.col("c_name").alias("word"), F.lower("c_mktsegment").alias("phonemes")
    )
    writers.write_dictionary(entries, path)
    return spark.read.text(path)


@query(
    "snk7_per_speaker",
    "SELECT s_nationkey AS speaker_id, CAST(count(*) AS BIGINT) AS sentences FROM supplier GROUP BY s_nationkey",
)
def snk7(spark, d):
    path = scratch_path(spark, "speakers")
    rows = table(spark, d, "supplier").select(F.col("s_name").alias("text"), F.col("s_nationkey").alias("speaker_id"))
    writers.write_per_speaker(rows, path)
    combined = spark.read.schema("text string, speaker_id int").json(path)
    return combined.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("sentences"))
