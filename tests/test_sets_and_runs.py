"""Shard sets, listings, rejects, lookups, long distances, bounded memory and whole runs."""

import functools
import json
import random
import re
import subprocess
import sys
import time
from pathlib import Path
from unittest import mock

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from contract import QUERIES
from tests import brute
from tests.conftest import SMALL
from tuturan import session
from tuturan.functions import arrow, scoring
from tuturan.operators import generate as G, lookup, stats, vocab
from tuturan.plans import benchmark, corpus, synthesis, vocabulary
from tuturan.sources import inventory, readers, rejects, shards, writers
from tuturan.streaming import incremental


# ------------------------------------------------------------------------------------------------ listing
def tree(folder):
    """Files in folders of folders, hidden and empty ones among them."""
    names = ["a/x.wav", "a/y.WAV", "a/b/x y+z%.wav", "é/n.wav", "a/.hidden.wav", "a/_tmp.wav", "_skip/x.wav", ".git/x.wav", "k=_v/q.wav", "a/empty.wav"]
    for i, name in enumerate(names):
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"" if "empty" in name else b"x" * (i + 1))


@pytest.mark.parametrize("pattern", ["*", "*.wav", "*.{wav,WAV}", "[xn].wav", "?.wav", "x y+z%.wav"])
def test_listing_equals_the_index_of_spark(spark, tmp_path, pattern):
    tree(tmp_path)
    ours = {tuple(r) for r in inventory.list_files(spark, str(tmp_path), pattern).collect()}
    index = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    assert ours == {tuple(r) for r in index.load(str(tmp_path)).select("path", "length").collect()}
    assert ours


def test_listing_of_nothing_and_of_many(spark, tmp_path):
    assert inventory.list_files(spark, str(tmp_path)).count() == 0
    for i in range(150):
        (tmp_path / f"d{i % 50}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 50}" / f"{i}.wav").write_bytes(b"x")
    assert inventory.list_files(spark, str(tmp_path), "*.wav").count() == 150


def test_unknown_schemes_are_listed_by_spark(spark, tmp_path, monkeypatch):
    (tmp_path / "a.wav").write_bytes(b"xy")

    def refuse(uri):
        raise pa.ArrowInvalid("unknown")

    monkeypatch.setattr(inventory, "_opened", refuse)
    assert inventory.list_files(spark, str(tmp_path)).first()["length"] == 2


def test_listing_tasks_need_no_installed_package(tmp_path):
    """A worker that cannot import the package runs the task as it was sent."""
    (tmp_path / "a.wav").write_bytes(b"xy")
    folders = mock.Mock()
    inventory._list_level(folders, functools.partial(inventory._opened, tmp_path.as_uri()), "/r")
    code = """
import pickle, sys
import pyarrow as pa
run = pickle.load(sys.stdin.buffer)
print([b.to_pylist() for b in run([pa.RecordBatch.from_pydict({"path": ["/r"]})])])
"""
    sent = cloudpickle.dumps(folders.mapInArrow.call_args.args[0])
    out = subprocess.run([sys.executable, "-I", "-c", code], input=sent, capture_output=True, cwd=tmp_path, timeout=60)
    assert out.stdout.decode().strip() == "[[{'path': '/r/a.wav', 'length': 2, 'is_folder': False}]]", out.stderr.decode()


@pytest.mark.parametrize(
    "pattern, yes, no",
    [("*.w?v", ["a.wav", ".wxv"], ["a.wv"]), ("{a,b*}.t[!x]t", ["a.tat", "bcd.tet"], ["a.txt", "ab.tat"]), (r"a\*", ["a*"], ["ab"]), ("a]b{", ["a]b{"], ["ab"])],
)
def test_name_patterns(pattern, yes, no):
    found = re.compile(inventory.glob_pattern(pattern))
    assert all(found.match(n) for n in yes) and not any(found.match(n) for n in no)


# ------------------------------------------------------------------------------------------------- shards
def put(folder, name, **columns):
    path = folder / name
    path.parent.mkdir(exist_ok=True)
    pq.write_table(pa.table(columns), path)


def tagged_rows(folder, name, *files):
    put(folder, name, audio_filename=list(files), segment_timestamp=[f"<|ms|> teks {f}<|1.00|>" for f in files])


def test_all_shards_of_a_corpus_are_read(spark, tmp_path):
    tagged_rows(tmp_path, "my talk+1-00000-of-00003.parquet", "a")
    tagged_rows(tmp_path, "my talk+1-00001-of-00003.snappy.parquet", "b", "c")
    tagged_rows(tmp_path, "my talk+1-00002-of-00003.parquet/part-0.parquet", "d")
    tagged_rows(tmp_path, "my talk+1-00002-of-00003.parquet/part-1.parquet", "e")
    tagged_rows(tmp_path, "my-00000-of-00001.parquet", "f")
    tagged_rows(tmp_path, "plain.parquet", "g")
    got = {(r["source"], r["audio_filename"]) for r in readers.read_tagged(spark, str(tmp_path)).collect()}
    assert got == {("my talk+1", f) for f in "abcde"} | {("my", "f"), ("plain", "g")}
    assert readers.read_tagged(spark, str(tmp_path), ["my talk+1", "plain"]).count() == 6
    sets = {r["corpus"]: r for r in shards.shard_sets(shards.shard_files(spark, str(tmp_path))).collect()}
    assert sets["my talk+1"]["files"] == 4 and sets["my talk+1"]["shards"] == 3 and sets["plain"]["shards"] is None
    with pytest.raises(ValueError, match="absent"):
        readers.read_tagged(spark, str(tmp_path), ["absent"])


def test_absent_shards_and_mixed_splits_are_errors(spark, tmp_path):
    tagged_rows(tmp_path, "one-00000-of-00003.parquet", "a")
    tagged_rows(tmp_path, "one-00002-of-00003.parquet", "b")
    tagged_rows(tmp_path, "two-00000-of-00001.parquet", "c")
    with pytest.raises(shards.MissingShards, match="one lacks 00001 of 00003"):
        readers.read_tagged(spark, str(tmp_path))
    assert readers.read_tagged(spark, str(tmp_path), ["two"]).count() == 1
    tagged_rows(tmp_path, "two-00001-of-00002.parquet", "d")
    with pytest.raises(shards.MissingShards, match="two mixes several splits"):
        readers.read_tagged(spark, str(tmp_path), ["two"])


def test_pairs_of_shard_sets(spark, tmp_path):
    text = lambda *t: {"new_text": list(t)}
    put(tmp_path, "one_segments-00000-of-00002.parquet", audio_filename=["a"], **text("satu"))
    put(tmp_path, "one_segments-00001-of-00002.parquet", audio_filename=["b"], **text("dua"))
    for k, f in enumerate("bac"):
        put(tmp_path, f"one_words-0000{k}-of-00003.parquet", audio_filename=[f, f], **text(f"w<|{k}.50|>", "w<|9.00|>"))
    put(tmp_path, "one-00000-of-00001.parquet", audio_filename=["z"], **text("tanpa akhiran"))
    put(tmp_path, "noise_words-00000-of-00001.parquet", audio_filename=["a"], **text("w<|7.00|>"))
    put(tmp_path, "audioset-00000-of-00001.parquet", audio_filename=["n"], **text("bising"))
    got = {tuple(r[c] for c in ("source", "audio_filename", "text", "duration")) for r in readers.read_paired(spark, str(tmp_path)).collect()}
    assert got == {("one", "a", "satu", 1.5), ("one", "b", "dua", 0.5)}  # a set with a suffix wins
    put(tmp_path, "one_words-00003-of-00005.parquet", audio_filename=["a"], **text("w<|7.00|>"))
    with pytest.raises(shards.MissingShards):
        readers.read_paired(spark, str(tmp_path))


# ------------------------------------------------------------------------------------------------ rejects
def test_rejects_keep_every_record(spark, tmp_path):
    good = [{"audio_filepath": f"{i}", "text": "é", "duration": i} for i in range(3)]
    bad = ["{broken", '{"audio_filepath": "x", "duration": "long"}', "12", '{"duration": [1]}', "[1, 2]"]
    (tmp_path / "m.json").write_text("\n".join([json.dumps(g) for g in good] + ["", "  "] + bad) + "\n")
    checked = rejects.checked_json(spark, str(tmp_path), readers.MANIFEST)
    assert {r["audio_filepath"] for r in rejects.accepted(checked).collect()} == {"0", "1", "2"}
    told = {r["record"]: r["reason"] for r in rejects.rejected(checked).collect()}
    assert told == {b: rejects.NOT_FITTING if b.startswith('{"') else rejects.NOT_JSON for b in bad}
    counts = rejects.write_checked(checked, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert sorted((Path(r["file"]).name, r["n"]) for r in counts.collect()) == [("m.json", 2), ("m.json", 3)]


def test_rejects_of_csv_and_of_whole_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('name,n\na,1\n"b, c",2\nd,x\ne\n')
    checked = rejects.checked_csv(spark, str(tmp_path / "t.csv"), "name string, n int")
    assert {tuple(r) for r in rejects.accepted(checked).collect()} == {("a", 1), ("b, c", 2)}
    assert {r["record"] for r in rejects.rejected(checked).collect()} == {"d,x", "e"}
    assert {r["name"] for r in readers.read_csv_records(spark, str(tmp_path / "t.csv"), {"name": "string", "n": "int"}).collect()} == {"a", "b, c"}
    folder = tmp_path / "hyp"
    folder.mkdir()
    (folder / "u1.json").write_text('{"text": "A",\n "text_norm": "a"}')
    (folder / "u2.json").write_text("{broken\n")
    whole = rejects.checked_json(spark, str(folder), readers.HYPOTHESIS, whole_files=True)
    assert [r["text_norm"] for r in rejects.accepted(whole).collect()] == ["a"]
    assert Path(rejects.rejected(whole).first()["file"]).name == "u2.json"


def test_skip_report(spark, tmp_path):
    rows = [(f"a{i}", "t", 1.0, None if i % 3 else ("x" if i % 2 else "y")) for i in range(20)]
    checked = spark.createDataFrame(rows, "audio_filepath string, text string, duration double, error string")
    writers.write_with_errors(checked.repartition(3), str(tmp_path / "good"), str(tmp_path / "bad"))
    written = writers.read_errors(spark, str(tmp_path / "bad"), readers.MANIFEST)
    got = {r["reason"]: r for r in stats.skip_report(checked, written=written).collect()}
    assert {k: r["n"] for k, r in got.items()} == {None: 13, "x": 3, "y": 4}
    assert all(r["total"] == 20 and r["valid"] == 13 and r["success_percent"] == 65.0 for r in got.values())
    assert {k: r["n_written"] for k, r in got.items()} == {None: 0, "x": 3, "y": 4} and got["x"]["files"] >= 1
    assert stats.skip_report(checked.where("error = 'x'")).first()["valid"] == 0
    assert stats.skip_report(checked.where("false")).count() == 0


# ------------------------------------------------------------------------------------------------- lookups
@pytest.mark.parametrize("limit", [lookup.TABLE_BYTES, 300, 0])
def test_lookup_in_place_and_by_join_agree(spark, monkeypatch, limit):
    """Held whole, cut down to the words that occur, and joined."""
    monkeypatch.setattr(lookup.small_table, "__defaults__", (limit,))
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["é", "日本", "it's"]
    known = {w: f"/{w[::-1]}/" for w in words[::2]} | {f"more{i}": "x" * 9 for i in range(200)}
    texts = [" ".join(rng.choice(words[:8]) for _ in range(rng.randrange(9))) + ", " + rng.choice(words).upper() for _ in range(80)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    entries = spark.createDataFrame(list(known.items()), "word string, phonemes string")
    got = {r["id"]: r["phonemes"] for r in vocab.to_phonemes(rows, entries).collect()}
    spoken = lambda t: re.sub(r"[\w']+", lambda m: known.get(m[0].lower(), m[0]), t or "")
    assert got == {i: spoken(t) for i, t in enumerate(texts)}
    covered = vocab.vocabulary_coverage(rows.withColumn("l", F.lit("x")), entries.withColumnRenamed("word", "token"), "id", "l").first()
    tokens = [w for t in texts if t for w in t.split()]
    assert (covered["total_tokens"], covered["total_unknown"]) == (len(tokens), sum(w not in known for w in tokens))


def test_large_dictionary_moves_a_text_once(spark, monkeypatch):
    """Shuffles take the bytes of the texts and of each part's words, not a row for every token."""
    monkeypatch.setattr(lookup.small_table, "__defaults__", (0,))
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    texts = [" ".join(rng.choice(words) for _ in range(1500)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(4)
    entries = spark.createDataFrame([(w, w[::-1]) for w in words[::2]], "word string, phonemes string")
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f: f.stat().st_size for d in folders for f in Path(d.getPath()).glob("*/shuffle_*.data")}
    before = files()
    vocab.to_phonemes(rows, entries).write.format("noop").mode("overwrite").save()
    assert sum(size for f, size in files().items() if f not in before) < 2 * sum(map(len, texts))


def test_shuffle_files_of_a_written_stage_go(spark):
    """At the end of the write, not when the driver happens to collect its garbage; the setting is as before."""
    counted = spark.range(20_000).repartition(8).groupBy((F.col("id") % 1000).alias("g")).count()
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f.name for d in folders for f in Path(d.getPath()).glob("*/shuffle_*.data")}
    before, usual = files(), spark.conf.get(session.CLEANUP, None)
    kept = session.store(counted, "counted", tidy=True)
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(session.CLEANUP, None) == usual
    assert kept.count() == counted.count() == 1000


def test_parts_of_a_large_dictionary(spark, monkeypatch):
    """Many parts, stretches of one task's rows, and parts over many batches; rows may be filtered later."""
    monkeypatch.setattr(lookup.small_table, "__defaults__", (0,))
    monkeypatch.setattr(lookup, "PART_TEXT", 400)
    monkeypatch.setattr(arrow, "_TOKENS", 5)
    known = {w: f"<{w}>" for w in ["a", "b\x01", "c\x02d", "é", "ος", "&", " ", "日本"]} | {f"w{i}": f"{i}" for i in range(0, 50, 2)}
    rng = random.Random(8)
    texts = [" ".join(rng.choice([f"w{i}", f"W{i}"]) for i in (rng.randrange(50) for _ in range(rng.randrange(12)))) for _ in range(120)]
    texts += ["A É É ΟΣ & && 日本", None, "", " ", *["w2, w3"] * 30]
    rows = spark.createDataFrame([(i, t, {"k": t}) for i, t in enumerate(texts)], "id int, text string, other map<string,string>")
    entries = spark.createDataFrame(list(known.items()), "word string, phonemes string")
    spoken = lambda t: "".join(known.get(k.lower(), k) for k in re.findall(r"[\w']+|[^\w\s]+|\s+", t or ""))
    want = {i: (t, {"k": t}, spoken(t)) for i, t in enumerate(texts)}
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(batch)
    spark.conf.set(batch, "7")
    try:
        for frame in (rows.coalesce(1), rows.repartition(20)):
            done = vocab.to_phonemes(frame, entries)
            assert done.columns == ["id", "text", "other", "phonemes"]
            got = done.collect()
            assert len(got) == len(want) and {r["id"]: tuple(r)[1:] for r in got} == want
            odd = {r["id"]: tuple(r)[1:] for r in done.where("id % 2 = 1").collect()}
            assert odd == {i: w for i, w in want.items() if i % 2}
        replaced = vocab.to_phonemes(rows, entries, name="text").collect()
        assert {r["id"]: r["text"] for r in replaced} == {i: w[2] for i, w in want.items()}
    finally:
        spark.conf.set(batch, usual)


def test_control_characters_are_not_mistaken_for_marks(spark):
    entries = spark.createDataFrame([("a", "1"), ("b", "2")], "word string, value string")
    table, buckets = lookup.small_table(entries, None)
    asked = ["a", "b", "c", "a\x02" + "1", "\x01a", "a\x02" + "1\x01b", ""]
    rows = spark.createDataFrame([(w,) for w in asked], "w string").withColumn("t", table)
    got = {r["w"]: r["v"] for r in rows.select("w", lookup.looked_up(F.col("t"), buckets, F.col("w")).alias("v")).collect()}
    assert got == {w: {"a": "1", "b": "2"}.get(w) for w in asked}
    assert lookup.small_table(spark.createDataFrame([("a\x01", "")], "word string, value string"), None) is None


# ----------------------------------------------------------------------------------------------- distances
def test_banded_and_diagonal_distances_are_exact(monkeypatch):
    monkeypatch.setattr(arrow, "_SHORT", 5)
    monkeypatch.setattr(arrow, "_FIRST_BAND", 1)
    rng, pairs = random.Random(3), []
    for _ in range(600):
        a = [rng.randrange(rng.choice([2, 5])) for _ in range(rng.randrange(25))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            b[rng.randrange(len(b) + 1) : rng.randrange(len(b) + 1)] = [rng.randrange(5)] * rng.randrange(2)
        pairs.append((np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)))
    totals = arrow._edit_totals(pairs)
    for (a, b), total in zip(pairs, totals):
        wanted = brute.edit_cost(list(a), list(b))
        assert divmod(int(total), arrow._BIG) == wanted
        assert arrow._furthest(a, b) == wanted[0]


def test_long_texts_cost_by_their_errors(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdé好😀 ") for _ in range(100_000))
    other = list(text)
    for k in (7, 20_000, 50_001, 99_999):
        other[k] = "#"
    del other[70_000]
    rows = [(text, "".join(other)), (text, text), ("kitten", "sitting"), (None, "ab"), ("", "")]
    frame = spark.createDataFrame(rows, "r string, h string")
    got = [r[0] for r in frame.select(scoring.char_errors(F.col("r"), F.col("h"))).collect()]
    assert got == [5, 0, 3, 2, 0]


# ------------------------------------------------------------------------------------------- bounded memory
def test_texts_are_forgotten_after_their_span(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def trigger(k, day, *texts):
        at = None if day is None else f"2024-01-{day:02}T00:00:00Z"
        lines = [json.dumps({"id": k * 10 + i, "text": t, "at": at}) for i, t in enumerate(texts)]
        (folder / f"{k}.json").write_text("\n".join(lines))
        stream = incremental.new_files(spark, str(folder), "id int, text string, at timestamp")
        incremental.append_unseen_for(stream, out, str(tmp_path / "cp"), ["id"], "at", "10 DAYS").awaitTermination()

    trigger(0, 1, "A", "b", " a ")
    trigger(1, 5, "a", "c")
    trigger(2, None, "d", "d", "c")
    trigger(3, 12, "A", "c", "d")
    kept = {r["id"] for r in spark.read.parquet(f"{out}/rows").collect()}
    assert kept == {0, 1, 11, 20, 30, 32}  # a is forgotten on day 11, c is not, d was never remembered
    assert {(r["batch"], r["digests"]) for r in incremental.remembered(spark, out).collect()} >= {(1, 1), (3, 2)}
    assert not (Path(out) / "digests" / "batch=0").exists()


# ---------------------------------------------------------------------------------------------------- runs
def test_test_set_with_other_column_names(spark, tmp_path):
    rows = spark.createDataFrame(
        [(3, "", "x.wav", 1.0), (1, " satu ", "x.wav", 1.0), (2, "dua", None, 1.0), (4, "tiga", "x", 0.05), (5, "lima", "x", None)],
        "idx int, Text string, WAV string, seconds double",
    )
    report = benchmark.prepare_test_set(rows, str(tmp_path / "o"), "set", "idx", "seconds")
    assert {r["reason"]: r["n"] for r in report.collect()} == {None: 1, "no text": 1, "no audio": 1, "too short": 1, "unreadable audio": 1}
    back = readers.read_benchmark(spark, str(tmp_path / "o" / "test")).collect()
    assert [(r["utterance_id"], r["path"], r["sentence"], r["duration"]) for r in back] == [("set_000000", "audio/set_000000.wav", "satu", "1.000")]
    with pytest.raises(ValueError):
        benchmark.prepare_test_set(rows.drop("Text"), str(tmp_path / "p"), "set", "idx", "seconds")


def test_keyed_corpus_needs_a_subset(spark, tmp_path):
    with pytest.raises(ValueError, match="none of"):
        corpus.read_subsets(spark, str(tmp_path), ["train_phase1"])


def test_manifest_specs():
    specs = ["a.json:50", "b.json", "s3://x/c.json:7", "d:e"]
    assert vocabulary.parse_manifests(specs) == [("a.json", 50), ("b.json", None), ("s3://x/c.json", 7), ("d:e", None)]


def test_tagging_run_without_field(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"audio_filepath": "a", "text": "hello there", "duration": 1}\n{"audio_filepath": "b", "text": "我你他的是不", "duration": 1}\n')
    counts = synthesis.tagging_run(spark, str(tmp_path / "m.json"), str(tmp_path / "o"), add_field=False)
    assert {(r["lang"], r["samples"], r["share"]) for r in counts.collect()} == {("en", 1, 50.0), ("zh", 1, 50.0)}
    assert "lang" not in spark.read.json(str(tmp_path / "o" / "manifest")).columns


# ------------------------------------------------------------------------------------------ shared folder
@pytest.mark.parametrize("named", ["/tmp/checkpoints", "file:///tmp/checkpoints", "s3a://bucket/checkpoints"])
def test_cluster_uses_the_folder_it_names(named):
    """A mounted folder has a path like any other; only a cluster that names none is refused."""
    context = mock.Mock(master="spark://host:7077")
    context.getConf.return_value.get.return_value = named
    context.getCheckpointDir.return_value = None
    context._jsc.hadoopConfiguration.return_value.get.return_value = "file:///"
    assert session.shared_dir(mock.Mock(sparkContext=context)) == named
    context.setCheckpointDir.assert_called_once_with(named)


def test_cluster_without_a_folder_is_refused():
    context = mock.Mock(master="spark://host:7077")
    context.getConf.return_value.get.return_value = None
    context.getCheckpointDir.return_value = None
    unset = mock.Mock(sparkContext=context)
    unset.conf.get.return_value = None
    with pytest.raises(ValueError, match="not set"):
        session.shared_dir(unset)


# Queries that keep stage tables in the shared folder.
STAGED = [
    "agg15_skip_report",
    "build_corpus",
    "build_keyed_corpus",
    "build_keyed_corpus_skipped",
    "build_speaker_corpus",
    "build_vocabulary",
    "generation_run",
    "gen4_incremental_batch",
    "join10_map_vocabulary_ids",
    "join1_match_utterances",
    "join4_spot_check",
    "join9_to_phonemes",
    "prepare_corpus",
    "prepare_speakers",
    "prepare_tagged_corpus",
    "prepare_test_set",
    "prj4_sequential_names",
    "score_benchmark",
    "run_benchmark",
]


@pytest.mark.parametrize("name", STAGED)
def test_query_runs_with_a_mounted_folder(spark, tmp_path, monkeypatch, name):
    """On a cluster whose shared folder is a path without a scheme; stage tables lie there."""
    context = spark.sparkContext
    settings = context.getConf().set("spark.checkpoint.dir", str(tmp_path))
    monkeypatch.setattr(context, "master", "spark://host:7077")
    monkeypatch.setattr(context, "getConf", lambda: settings)
    assert QUERIES[name](spark, SMALL).count() > 0
    assert any(tmp_path.iterdir())


# --------------------------------------------------------------------------------------- memory and tasks
def test_text_functions_see_small_parts(spark):
    """A part holds at most a megabyte, or one longer text; order, nulls and empty texts stay."""
    texts = pa.array(["é" * 300_000, None, "x" * 3_000_000, "", None, *["ab" * 100_000] * 12, "z"], pa.string())
    sizes = []

    def double(part):
        sizes.append((len(part), sum(len(t.encode()) for t in part)))
        return part + part

    done = arrow._in_parts(texts, double)
    assert done.to_pylist() == [t if t is None else t + t for t in texts.to_pylist()]
    assert all(n <= 1 or size <= 1 << 20 for n, size in sizes)
    assert arrow._in_parts(texts.slice(0, 0), double).to_pylist() == []
    rows = spark.createDataFrame([(1, "é"), (2, None), (3, "")], "i int, t string")
    seen = {r["i"]: (r["n"], r["m"]) for r in rows.select("i", arrow.nfc(F.col("t")).alias("n"), arrow.map_text(lambda s: s.str.upper(), F.col("t")).alias("m")).collect()}
    assert seen == {1: ("é", "É"), 2: (None, None), 3: ("", "")}


# ------------------------------------------------------------------------------------------ generation at size
def test_few_persons_are_dealt_out(spark):
    """One person's sentences are made by many tasks, and are the same as before."""
    one = spark.createDataFrame([("Ali",)], "name string")
    templates = ["{name} nombor satu.", "{name} nombor dua."]
    with mock.patch.object(synthesis, "generate_until") as until:
        synthesis.next_batch(one, templates, 50_000, 1)
    made = until.call_args.args[0](3, 50_000)
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 50_000 and max(sizes) <= 12_000
    plain = G.generate_sentences(one, templates, 50_000, first_round=3)
    assert made.exceptAll(plain).isEmpty() and plain.exceptAll(made).isEmpty()


def test_repeated_persons_say_the_same(spark):
    """Copies of a person add no rounds that only repeat what one of them has said."""
    copies = spark.range(120).select("id", F.concat(F.lit("P"), (F.col("id") % 3).cast("string")).alias("name"))
    with mock.patch.object(synthesis, "generate_sentences", wraps=G.generate_sentences) as make:
        batch = synthesis.next_batch(copies, ["{name} bayar {amount}, rujukan {ref_number}."], 60, 1)
        assert batch.select("text").distinct().count() == 60
    assert make.call_count <= 2
