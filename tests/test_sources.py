import json
import wave

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tuturan.sources import readers, writers
from tuturan.streaming import incremental
from tuturan.functions.text import strip_markers

TAG = "<|startoftranscript|><|{}|><|0.00|> {}<|{}|>"


def shard(folder, name, **columns):
    pq.write_table(pa.table(columns), folder / f"{name}-00000-of-00001.parquet")


def test_tagged_shards(spark, tmp_path):
    shard(tmp_path, "news", audio_filename=["a", "b", None], segment_timestamp=[TAG.format("ms", "satu  dua", "1.50"), "<|ms|> ", "x"])
    shard(tmp_path, "talk", audio_filename=["c", "d"], segment_timestamp=["plain", None])
    rows = {r["audio_filename"]: tuple(r) for r in readers.read_tagged(spark, str(tmp_path)).collect()}
    assert rows == {"a": ("a", "satu dua", 1.5, "news", "ms"), "c": ("c", "plain", 0.0, "talk", "unknown")}
    assert readers.read_tagged(spark, str(tmp_path), ["talk"]).count() == 1


def test_paired_shards(spark, tmp_path):
    shard(tmp_path, "one_segments", audio_filename=["a", "b", "c"], new_text=["<|x|> satu", "dua", ""])
    shard(tmp_path, "one_words", audio_filename=["a", "a", "z"], new_text=["w<|2.25|>", "w<|9.00|>", "w<|1.00|>"])
    shard(tmp_path, "two_segment_timestamp", audio_filename=["a"], new_text=["lain"])
    shard(tmp_path, "noise_set", audio_filename=["n"], new_text=["bising"])
    shard(tmp_path, "solo", audio_filename=["s"], new_text=["sendiri"])
    got = {(r["source"], r["audio_filename"]): (r["text"], r["duration"]) for r in readers.read_paired(spark, str(tmp_path)).collect()}
    assert got == {("one", "a"): ("satu", 2.25), ("one", "b"): ("dua", 0.0), ("two", "a"): ("lain", 0.0), ("solo", "s"): ("sendiri", 0.0)}
    with pytest.raises(ValueError):
        readers.read_paired(spark, str(tmp_path), ["absent"])


def test_json_records_both_forms(spark, tmp_path):
    item = {"text": "t", "audio_path": "a.wav", "duration": 1.5, "index": 3}
    (tmp_path / "bare.json").write_text(json.dumps([item, item], indent=1))
    (tmp_path / "wrapped.json").write_text(json.dumps({"results": [item], "metadata": {"n": 1}}))
    assert readers.read_json_records(spark, str(tmp_path)).count() == 3
    (tmp_path / "rows.csv").write_text("audio_path,text\na.wav,hello\n")
    assert readers.read_csv_records(spark, str(tmp_path / "rows.csv")).first()["text"] == "hello"


def test_manifest_skips_broken_lines(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('{"audio_filepath": "a", "text": "é", "duration": 1.0}\n\n{broken\n{"audio_filepath": "b", "text": "t", "duration": 2}\n')
    assert {r["audio_filepath"] for r in readers.read_manifest(spark, str(path)).collect()} == {"a", "b"}


def test_keyed_text(spark, tmp_path):
    (tmp_path / "text").write_text("u1 first\nu2\n\nu1   last one \nu3\tx y\n")
    (tmp_path / "wav.scp").write_text("u1 a.wav\nu2\nu4 d.wav\n")
    assert {tuple(r) for r in readers.read_transcripts(spark, str(tmp_path / "text")).collect()} == {("u1", "last one"), ("u2", ""), ("u3", "x y")}
    assert {tuple(r) for r in readers.read_audio_paths(spark, str(tmp_path / "wav.scp")).collect()} == {("u1", "a.wav"), ("u4", "d.wav")}


def test_benchmark_table_and_hypotheses(spark, tmp_path):
    rows = spark.createDataFrame([("x", "audio/u1.wav", "satu", 1.5)], "utterance_id string, path string, sentence string, duration double")
    writers.write_benchmark(rows, str(tmp_path / "t"))
    back = readers.read_benchmark(spark, str(tmp_path / "t")).first()
    assert tuple(back) == ("u1", "audio/u1.wav", "satu", "1.500")
    folder = tmp_path / "hyp"
    folder.mkdir()
    (folder / "u1.json").write_text('{"text": "Satu", "text_norm": "satu"}')
    (folder / "u2.json").write_text('{"text": "x"}')
    (folder / "u3.json").write_text("{broken")
    got = {tuple(r) for r in readers.read_hypotheses(spark, str(folder)).collect()}
    assert {("u1", "satu"), ("u2", "")} <= got and all(h == "" for u, h in got if u == "u3")


def test_conversations(spark, tmp_path):
    turn = lambda t, **m: {"text": t, "metadata": m}
    lines = [
        {"uid": "BANK_PAY_1", "conversation": [turn("", start_time=1.0, end_time=3.5), turn(" hai ")]},
        {"uid": "short", "conversation": [turn("x")]},
        {"uid": "silent", "conversation": [turn(""), turn("  ")]},
    ]
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in lines) + "\nnot json\n")
    assert [tuple(r) for r in readers.read_conversations(spark, str(path)).collect()] == [("BANK_PAY_1", "audio/BANK_PAY_1.wav", "hai", 2.5)]


def test_audio_headers_and_inventory(spark, tmp_path):
    for name, seconds, channels in (("ok", 4, 1), ("short", 1, 2)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as out:
            out.setnchannels(channels)
            out.setsampwidth(2)
            out.setframerate(16000)
            out.writeframes(b"\0\0" * channels * 16000 * seconds)
    (tmp_path / "cut.wav").write_bytes((tmp_path / "ok.wav").read_bytes()[:20])
    rows = {r["path"].rsplit("/", 1)[1]: r for r in readers.audio_headers(spark, str(tmp_path)).collect()}
    assert (rows["ok.wav"]["duration"], rows["ok.wav"]["sample_rate"], rows["ok.wav"]["channels"], rows["ok.wav"]["errors"]) == (4.0, 16000, 1, [])
    assert rows["short.wav"]["errors"] == ["Too short: 1.00s < 3.0s"]
    assert rows["cut.wav"]["errors"]
    assert readers.audio_inventory(spark, str(tmp_path), "*.wav").count() == 3


def test_templates_dictionary_vocabulary(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"description": "x", "categories": {"a": ["{name} 1", "2"], "b": ["3"]}}))
    got = {(r["category"], r["template"]) for r in readers.read_templates(spark, str(tmp_path / "t.json")).collect()}
    assert got == {("a", "{name} 1"), ("a", "2"), ("b", "3")}
    entries = spark.createDataFrame([("pagi", "p a"), ("dunia", "d u")], "word string, phonemes string")
    writers.write_dictionary(entries, str(tmp_path / "dict"))
    assert {tuple(r) for r in readers.read_dictionary(spark, str(tmp_path / "dict")).collect()} == {("pagi", "p a"), ("dunia", "d u")}
    (tmp_path / "v.txt").write_text("▁a\t-1.5\nb\n")
    assert {tuple(r) for r in readers.read_vocabulary(spark, str(tmp_path / "v.txt")).collect()} == {("▁a", -1.5), ("b", None)}
    spec = spark.createDataFrame([("zh.json:5000",), ("train.json",), ("C:\\x",)], "s string")
    path, limit = readers.parse_spec(F.col("s"))
    assert [tuple(r) for r in spec.select(path, limit).collect()] == [("zh.json", 5000), ("train.json", None), ("C:\\x", None)]


def test_results_files(spark, tmp_path):
    scored = spark.createDataFrame([("m", "d", "1", "a b", "a c", 1, 2, 0.5), ("m", "d", "2", "x", "x", 0, 1, 0.0)], "model string, dataset string, utterance_id string, reference string, hypothesis string, errors bigint, ref_words bigint, wer double")
    writers.write_results(scored, str(tmp_path / "r"))
    cell = spark.read.json(str(tmp_path / "r/totals")).first()
    assert cell["num_samples"] == 2 and abs(cell["overall_wer"] - 1 / 3) < 1e-9
    rows = spark.read.json(str(tmp_path / "r/utterances")).where("model = 'm' AND dataset = 'd'")
    assert rows.count() == 2 and rows.where("groundtruth = 'a b' AND predicted = 'a c'").count() == 1
    rows = spark.createDataFrame([("a.wav", "x|y", "s")], "f string, t string, s string")
    writers.write_pipe_metadata(rows, str(tmp_path / "p"), ["f", "t", "s"])
    assert spark.read.text(str(tmp_path / "p")).first()[0] == "a.wav|x y|s"


def test_resume_and_deduplicate(spark, tmp_path):
    source, output, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    write = lambda rows: spark.createDataFrame(rows, "id int, text string").coalesce(1).write.mode("append").json(source)
    run = lambda: incremental.resume_build(incremental.new_files(spark, source, "id int, text string"), incremental.unseen_text, output, progress).awaitTermination()
    write([(1, "Satu"), (2, "dua"), (3, " satu ")])
    run()
    assert spark.read.parquet(output).count() == 2
    write([(4, "DUA"), (5, "tiga")])
    run()
    assert sorted(r["text"].strip().lower() for r in spark.read.parquet(output).collect()) == ["dua", "satu", "tiga"]
    run()
    assert spark.read.parquet(output).count() == 3


def test_bounded_deduplication(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("a", "2024-01-01 00:00:00"), ("A ", "2024-01-02 00:00:00"), ("b", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "text string, at string").select("text", F.to_timestamp("at").alias("at")).coalesce(1).write.parquet(source)
    stream = incremental.new_files(spark, source, "text string, at timestamp", "parquet")
    kept = incremental.unseen_text(stream, event_time="at")
    prepare = lambda df: incremental.unseen_text(df, event_time="at").select(strip_markers(F.col("text")).alias("text"))
    assert kept.isStreaming
    incremental.resume_build(stream, prepare, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert sorted(r["text"].lower() for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
