import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tuturan.operators import filters, generate as G, joins, ranks, stats, vocab, wer
from tuturan.plans import benchmark, corpus as plan, synthesis


@pytest.fixture(scope="module")
def skewed(spark):
    """One source holds most rows, and a third of all rows are copies of one key."""
    rows = [(f"k{i}", "big", i) for i in range(400)] + [("copy", "big", i) for i in range(400, 700)]
    rows += [(f"s{i}", f"small{i % 7}", 1000 + i) for i in range(97)] + [("one", "single", 5000), ("null", None, 6000)]
    return spark.createDataFrame(rows, "key string, source string, row int").repartition(5)


@pytest.mark.parametrize("ratio", [0.0, 0.5, 0.9, 0.95, 1.0])
def test_split_sizes_are_exact_with_copies(skewed, ratio):
    rows = ranks.stratified_split(skewed, ["source"], ["key"], ratio).collect()
    assert sorted(r["row"] for r in rows) == sorted(r["row"] for r in skewed.collect())
    total, train = Counter(r["source"] for r in rows), Counter(r["source"] for r in rows if r["split"] == "train")
    assert all(train[s] == math.floor(n * ratio) for s, n in total.items())


def test_split_depends_on_seed_only(skewed):
    unique = skewed.where("key <> 'copy'")
    split = lambda seed: {r["row"] for r in ranks.stratified_split(unique, ["source"], ["key"], 0.5, seed).where("split = 'train'").collect()}
    assert split(1) == split(1) != split(2)


def test_samples_are_exact(skewed):
    assert ranks.seeded_sample(skewed, 333, ["key"]).count() == 333
    assert ranks.seeded_sample(skewed, 5000, ["key"]).count() == skewed.count()
    assert ranks.seeded_sample(skewed, 0, ["key"]).count() == 0
    per_group = Counter(r["source"] for r in ranks.equal_quota(skewed, 100, 10, "source", ["key"]).collect())
    assert per_group["big"] == 10 and per_group["single"] == 1 and per_group["small0"] == 10
    pair = ranks.reservoir_pair(skewed.where("source = 'big'"), skewed.where("source <> 'big'"), 41, ["key"])
    assert Counter(r["source"] == "big" for r in pair.collect()) == {True: 20, False: 21}


def test_numbering(skewed):
    rows = ranks.number_rows(skewed, "row").collect()
    assert [r["number"] for r in sorted(rows, key=lambda r: r["row"])] == list(range(1, len(rows) + 1))
    by = defaultdict(list)
    for r in ranks.number_rows(skewed, "row", ["source"]).collect():
        by[r["source"]].append((r["row"], r["number"]))
    assert all([n for _, n in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())
    shares = Counter(r["share"] for r in ranks.work_shares(skewed, 6, ["row"]).collect())
    assert max(shares.values()) - min(shares.values()) <= 1 and len(shares) == 6
    shuffled = [r["row"] for r in ranks.shuffle_rows(skewed, ["row"]).collect()]
    assert sorted(shuffled) == sorted(r["row"] for r in skewed.collect()) and shuffled != sorted(shuffled)


def test_first_per_key_is_idempotent(skewed):
    once = ranks.first_per_key(skewed, joins.text_key(F.col("key")), ["row"])
    assert once.count() == 500
    assert once.where("key = 'copy'").first()["row"] == 400
    assert ranks.first_per_key(once, joins.text_key(F.col("key")), ["row"]).count() == 500


def test_duration_filter_needs_a_known_duration(spark):
    rows = spark.createDataFrame([(0.0,), (5.0,), (40.0,)], "duration double")
    assert filters.duration_between_if_known(rows).count() == 1
    assert filters.duration_between_if_known(rows.where("duration = 0")).count() == 1


def test_attrition_sums_to_the_input(spark):
    rows = spark.range(100).withColumn("text", F.when(F.col("id") % 3 == 0, "").otherwise("x"))
    stages = [filters.Stage("even", F.col("id") % 2 == 0), filters.Stage("text", F.col("text") != ""), filters.Stage("any", F.lit(True))]
    out = filters.attrition(rows, stages).orderBy("step").collect()
    assert [(r["stage"], r["dropped"], r["remaining"]) for r in out] == [("even", 50, 50), ("text", 17, 33), ("any", 0, 33)]


def test_validation_and_paths(spark):
    rows = spark.createDataFrame(
        [("a.wav", " t ", "2.5"), ("/x/b.wav", "t", "x"), (None, "t", "1"), ("c.wav", None, "1"), ("d.wav", "  ", "1"), ("e.wav", "t", "0")],
        "audio_path string, text string, duration string",
    )
    out = filters.validate_samples(rows, "/base").collect()
    assert [r["error"] for r in out] == [None, "bad duration", "missing audio path", "missing transcription", "empty transcription", "bad duration"]
    assert (out[0]["audio_filepath"], out[0]["text"], out[0]["duration"]) == ("/base/a.wav", "t", 2.5)
    assert out[1]["audio_filepath"] == "/x/b.wav"
    names = spark.createDataFrame([("BANK_PAY_1",), ("X",)], "u string").select(filters.id_category(F.col("u"))).collect()
    assert [r[0] for r in names] == ["PAY", "OTHER"]
    with pytest.raises(ValueError):
        filters.first_present(["a"], ["b"])


def test_wer_scopes(spark):
    refs = spark.createDataFrame([("1", "the cat sat on the mat"), ("2", "a b"), ("3", "")], "utterance_id string, reference string")
    hyps = spark.createDataFrame([("1", "the cat sit on mat now"), ("3", ""), ("9", "z")], "utterance_id string, hypothesis string")
    both = wer.corpus_wer(wer.score_utterances(wer.pair_with_reference(hyps, refs))).first()
    assert (both["samples"], both["errors"], both["ref_words"], both["wer"]) == (2, 3, 6, 0.5)
    failed = wer.score_utterances(wer.pair_with_reference(hyps, refs, keep_failed=True))
    assert wer.corpus_wer(failed).first()["errors"] == 5
    assert failed.where("utterance_id = '3'").first()["wer"] is None
    same = wer.score_utterances(refs.withColumn("hypothesis", F.col("reference")))
    assert wer.corpus_wer(same).first()["errors"] == 0


def test_benchmark_scopes(spark):
    refs = spark.createDataFrame([("d", "1", "Satu, dua!", "ms"), ("d", "2", "tiga", "ms"), ("z", "1", "你好。", "zh")], "dataset string, utterance_id string, reference string, language string")
    hyps = spark.createDataFrame([("m", "d", "1", "satu dua"), ("m", "z", "1", "你 坏")], "model string, dataset string, utterance_id string, hypothesis string")
    scored = benchmark.score_benchmark(hyps, refs)
    long, matrix = benchmark.summarize(scored, ["d", "z", "none"])
    assert {(r["dataset"], r["errors"], r["ref_words"]) for r in long.collect()} == {("d", 1, 3), ("z", 1, 2)}
    row = matrix.first()
    assert row["z"] == 0.5 and math.isnan(row["none"])
    raw = benchmark.score_benchmark(hyps, refs, benchmark.BenchmarkOptions(keep_failed=False, normalize_reference=False))
    assert {(r["dataset"], r["errors"]) for r in raw.collect()} == {("d", 2), ("z", 2)}


def test_comparison(spark):
    base = spark.createDataFrame([("1", 0.5), ("2", 0.2), ("3", 0.1)], "utterance_id string, wer double")
    other = spark.createDataFrame([("1", 0.1), ("2", 0.9), ("3", 0.1)], "utterance_id string, wer double")
    compared = wer.compare_runs(base, other)
    summary = wer.comparison_summary(compared).first()
    assert (summary["better"], summary["worse"], summary["same"], summary["net"]) == (1, 1, 1, 0)
    assert {r["utterance_id"] for r in wer.extremes(compared, 5).collect()} == {"1", "2"}


def test_dictionary_lookup_keeps_everything(spark):
    data = [(1, "Selamat pagi,  dunia! xyz", "x"), (2, "", "y"), (3, None, "z"), (1, "pagi b", None), (1, "pagi b", None)]
    rows = spark.createDataFrame(data, "id int, text string, other string").repartition(2)
    words = spark.createDataFrame([("PAGI", "p a g i"), ("dunia", "d u")], "word string, phonemes string")
    got = vocab.to_phonemes(rows, words)
    assert got.columns == ["id", "text", "other", "phonemes"]
    spoken = ["Selamat p a g i,  d u! xyz", "", "", "p a g i b", "p a g i b"]
    want = [(*row, out) for row, out in zip(data, spoken)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_numbering_with_nulls_and_copies(spark):
    data = [(k % 7 if k % 5 else None, "g" if k % 3 else None, k // 2) for k in range(400)] + [(1, "g", 0)] * 5
    frames = [spark.createDataFrame(data, "key int, g string, v int").repartition(n) for n in (2, 5)]
    for by in ([], ["g"]):
        got = [sorted(map(str, map(tuple, ranks.number_rows(f, "key", by).collect()))) for f in frames]
        assert got[0] == got[1]
        numbers = defaultdict(list)
        for r in ranks.number_rows(frames[0], "key", by).collect():
            numbers[r["g"] if by else 0].append((r["number"], r["key"] is None, r["key"] or 0))
        for own in numbers.values():
            assert [n for n, _, _ in sorted(own)] == list(range(1, len(own) + 1))
            assert [x[1:] for x in sorted(own)] == sorted(x[1:] for x in own)
    assert ranks.number_rows(frames[0].where("false"), "key").count() == 0


def test_samples_do_not_depend_on_partitions(spark):
    data = [(k % 11, k) for k in range(40)] + [(1, 1)] * 6
    frames = [spark.createDataFrame(data, "key int, v int").repartition(n) for n in (2, 5)]
    for size in range(0, 46, 7):
        got = [sorted(map(tuple, ranks.seeded_sample(f, size, ["key"]).collect())) for f in frames]
        assert got[0] == got[1] and len(got[0]) == size


def test_cut_buckets_are_refined(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id", "id % 2 AS g")
    want = sorted(tuple(r) for r in ranks.seeded_sample(rows, 700, ["id"], ["g"]).collect())
    monkeypatch.setattr(ranks, "CUT_ROWS", 1)
    monkeypatch.setattr(ranks, "BUCKET_DIGITS", 1)
    assert sorted(tuple(r) for r in ranks.seeded_sample(rows, 700, ["id"], ["g"]).collect()) == want and len(want) == 1400


def test_vocabulary(spark):
    docs = spark.createDataFrame([(1, "ms", "a b c"), (2, "ms", "a a"), (3, "zh", "  ")], "id int, lang string, text string")
    known = spark.createDataFrame([("a",), ("b",)], "token string")
    out = {r["lang"]: r for r in vocab.vocabulary_coverage(docs, known, "id", "lang").collect()}
    assert out["ms"]["total_tokens"] == 5 and out["ms"]["total_unknown"] == 1
    assert abs(out["ms"]["avg_coverage"] - (2 / 3 + 1) / 2) < 1e-9 and not out["zh"]["supported"]
    first = spark.createDataFrame([("x", 5), ("y", 3), ("z", 1)], "token string, freq bigint")
    second = spark.createDataFrame([("z", 9), ("w", 1)], "token string, freq bigint")
    merged = {r["token"]: r["freq"] for r in vocab.combined_vocabulary([first, second], [2, 1]).collect()}
    assert merged == {"x": 5, "y": 3, "z": 10}


def test_statistics(spark):
    rows = spark.createDataFrame([("a", 10.0, "xx"), ("a", 30.0, "xxxx"), ("b", 3600.0, "x")], "source string, duration double, text string")
    by = {r["source"]: r for r in stats.statistics_with_share(rows, ["source"]).collect()}
    assert by["a"]["samples"] == 2 and by["a"]["avg_chars"] == 3.0 and abs(by["b"]["share"] - 100 / 3) < 1e-9
    spread = stats.length_distribution(rows).first()
    assert spread["median_chars"] == 2.0 and spread["max_chars"] == 4
    assert stats.key_uniqueness(rows, "source").first()["is_unique"] is False
    with pytest.raises(ValueError):
        stats.require_unique(rows, "source")
    latest = spark.createDataFrame([("checkpoint-9",), ("checkpoint-10",), ("none",)], "n string")
    assert stats.latest_by_number(latest, F.col("n")).first()["latest"] == "checkpoint-10"


def test_generation(spark):
    people = spark.createDataFrame([(f"p{i}", "Datuk") for i in range(30)], "name string, honorific string")
    templates = ["{name} bayar {amount}.", "{honorific} {name} umur {number1}.", "rosak {tiada}"]
    made = G.generate_sentences(people, templates, 5)
    again = G.generate_sentences(people, templates, 5)
    assert sorted(made.collect()) == sorted(again.collect())
    assert made.where(F.col("text").rlike(r"[{}\d\x01\x02]")).where("NOT text LIKE '%p%'").count() == 0
    first = synthesis.next_batch(people, templates, 60, 2)
    keys = lambda df: {r["text"].lower() for r in df.collect()}
    assert first.count() == 60 and len(keys(first)) == 60
    few = synthesis.next_batch(people, ["{name} hadir."], 500, 2, allow_short=True)
    assert few.count() == 30
    with pytest.raises(G.TooFewSentences):
        synthesis.next_batch(people, ["{name} hadir."], 500, 2)
    three = people.limit(3)
    assert synthesis.next_batch(three, ["{name} bayar {amount}, rujukan {ref_number}."], 700, 1).count() == 700
    titled = spark.createDataFrame([("A", "menteri")], "name string, title string")
    assert G.generate_sentences(titled, ["{name} {position}."], 1).first()["text"] == "A menteri."
    second = synthesis.next_batch(people, templates, 40, 2, earlier=first)
    assert not keys(first) & keys(second)


def test_quota_plan(spark):
    speakers = spark.createDataFrame([("s1",)], "speaker_id string")
    plan_rows = G.quota_plan(speakers, F.lit(240), [("a", 0.6), ("b", 0.4)], [("t1", 0.15), ("t2", 0.85)], ["x", "y"]).collect()
    got = {(r["language"], r["topic"]): r["n"] for r in plan_rows}
    assert got == {("a", "t1"): 11, ("a", "t2"): 61, ("b", "t1"): 7, ("b", "t2"): 40}


def test_corpus_plan(spark):
    rows = [(f"f{i}", "Saya beli 5 kg!" if i % 2 else "buruk ж", 5.0 if i % 5 else 99.0, "s", "ms") for i in range(40)]
    df = spark.createDataFrame(rows, "audio_filename string, text string, duration double, source string, language string")
    options = plan.CorpusOptions(clean_for_asr=True, train_split=0.75, filter_invalid_chars=True)
    out = plan.prepare_corpus(df, options).collect()
    assert {r["text"] for r in out} == {"saya beli lima kilogram"}
    assert Counter(r["split"] for r in out) == {"train": 12, "val": 4}
    funnel = {r["stage"]: r["dropped"] for r in plan.corpus_attrition(df, options).collect()}
    assert funnel == {"duration": 8, "script": 16, "empty": 0, "characters": 0}
    assert plan.prepare_corpus(df, plan.CorpusOptions(max_samples=10, preprocess=False, exclude_non_latin=False, max_duration=100.0)).count() == 10


def test_subset_routing(spark):
    rows = spark.range(40).select(F.col("id"), F.when(F.col("id") < 20, "train_phase1").otherwise("test").alias("subset"))
    counts = lambda df: Counter(r["split"] for r in df.collect())
    assert counts(plan.route_subsets(rows, ["id"])) == {"train": 19, "val": 1, "test": 20}
    with_dev = rows.withColumn("subset", F.when(F.col("id") == 0, "dev_phase2").otherwise(F.col("subset")))
    assert counts(plan.route_subsets(with_dev, ["id"])) == {"train": 19, "val": 1, "test": 20}
    keyed = rows.select(F.col("id"), F.lit("你好。").alias("text"), F.lit(1.23456).alias("duration"))
    assert plan.prepare_keyed_corpus(keyed).first()["duration"] == 1.2346
