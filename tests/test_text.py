import random
import unicodedata

import brute
import pytest
from pyspark.sql import functions as F

from tuturan.functions import arrow, asr, expr, language as L, numbers as N, repetition, scoring as S, text as X

GOLDEN_ZH = [
    ("我今年２５岁。", "我今年25岁"),
    ("价格是１００元！", "价格是100元"),
    ("<SPOKEN_NOISE>你好，世界！", "你好世界"),
    ("第1个问题是什么？", "第1个问题是什么"),
    ("Ａ　Ｂ　Ｃ，这是全角字符。", "A B C这是全角字符"),
    ("[noise]今天天气很好。[laughter]", "今天天气很好"),
]
TAGS = "<|startoftranscript|><|ms|><|transcribe|><|0.00|> a  b<|1.42|><|endoftext|>"


def test_markers(apply):
    assert apply(X.strip_markers, [TAGS, "plain"]) == ["a b", "plain"]
    assert apply(X.marker_language, [TAGS, "plain"]) == ["ms", "unknown"]
    assert apply(X.marker_duration, [TAGS, "plain"]) == [1.42, 0.0]


def test_chinese_golden_pairs(apply):
    assert apply(X.preprocess_zh, [a for a, _ in GOLDEN_ZH]) == [b for _, b in GOLDEN_ZH]
    assert apply(lambda c: asr.preprocess_asr(c, "zh", clean_for_asr=True), [GOLDEN_ZH[2][0]]) == ["你好世界"]
    assert apply(X.remove_chinese_punctuation, ["don't \"x\" 。"]) == ["don't x "]


def test_abbreviations_and_particles(apply):
    cases = ["Dr. Smith", "no way no no", "e.g. this", "dr.mr x", "km² km", "éno noé", "Mr.dr.No", "etc.", "Hrs and HR"]
    assert apply(X.expand_abbreviations, cases) == [brute.ordered_fold(c, X.ABBREVIATIONS["en"]) for c in cases]
    assert apply(X.expand_abbreviations, ["Dr. Smith", "no way"]) == ["doctor. Smith", "number way"]
    malay = ["En. Ahmad di Jln. Merdeka", "Dato' Ali", "dato'x tan sri. Abu", "dato.Ali", "yg dgn utk", "en.dr.pn.x"]
    fold = lambda c: X.expand_abbreviations(c, "ms")
    assert apply(fold, malay) == [brute.ordered_fold(c, X.ABBREVIATIONS["ms"]) for c in malay]
    spoken = ["Good laah", "like lor", "Can lahhh", "la le LOO ar ya yaaah", "me meh", "kaan hoor ahhh"]
    assert apply(X.normalize_particles, spoken) == [brute.ordered_fold(c, X.PARTICLES) for c in spoken]
    assert apply(X.normalize_particles, ["Good laah", "like lor", "Can lahhh"]) == ["Good lah", "like lah", "Can lahhh"]


def test_random_folds(apply):
    rng = random.Random(5)
    stems = ["dr", "Mr", "no", "st", "e.g", "i.e", "vs", "ms", "la", "lor", "ya", "x", "é", "5", "dato", "tan sri", "en"]
    glue = ["", ".", " ", ". ", "'", "'.", ", ", "-"]
    texts = ["".join(rng.choice(stems) + rng.choice(glue) for _ in range(12)) for _ in range(300)]
    for code in ("en", "ms"):
        assert apply(lambda c: X.expand_abbreviations(c, code), texts) == [
            brute.ordered_fold(t, X.ABBREVIATIONS[code]) for t in texts
        ]
    assert apply(X.normalize_particles, texts) == [brute.ordered_fold(t, X.PARTICLES) for t in texts]


def test_characters(apply):
    assert apply(X.normalize_characters, ["“a”—b c​…"]) == ['"a"-b c...']
    assert apply(X.remove_emoji, ["a\U0001F600\U0001F680b☀️"]) == ["ab"]
    assert apply(X.clean_for_asr, ["Café, (x) \U0001F600 a@b-c's ×"]) == ["Café x a@b-c's"]
    assert apply(X.invalid_characters, ["a!b?!"]) == [["!", "?"]]
    assert apply(X.is_valid_text, ["ok é", "no!", " ", None]) == [True, False, False, False]
    assert apply(X.contains_non_latin, ["abc é", "ж", "ab好"]) == [False, True, True]
    assert apply(X.expand_speech_abbreviations, ["Yg, mcm apa2!  x"]) == ["yang, macam apa-apa! tidak"]
    composed = apply(arrow.nfc, ["é café", "plain", None, "Å"])
    assert composed == ["é café", "plain", None, "Å"]
    every = [chr(c) + t for c in range(0x20, 0xFFFF, 7) if not 0xD800 <= c < 0xE000 for t in ("", "́")]
    assert apply(arrow.nfc, every) == [unicodedata.normalize("NFC", t) for t in every]


@pytest.mark.parametrize(
    "n, ms, en, zh",
    [
        (0, "kosong", "zero", "零"),
        (11, "sebelas", "eleven", "十一"),
        (15, "lima belas", "fifteen", "十五"),
        (100, "seratus", "one hundred", "一百"),
        (105, "seratus lima", "one hundred and five", "一百零五"),
        (1000000, "sejuta", "one million", "一百万"),
        (-7, "negatif tujuh", "minus seven", "负七"),
    ],
)
def test_number_words(spark, n, ms, en, zh):
    row = spark.range(1).select(N.malay_words(F.lit(n)), N.english_words(F.lit(n)), N.chinese_words(F.lit(n))).first()
    assert tuple(row) == (ms, en, zh)


def test_malay_words_against_recursion(apply):
    rng = random.Random(1)
    numbers = list(range(0, 1200)) + [rng.randrange(10 ** rng.randrange(1, 19)) for _ in range(400)]
    assert apply(N.malay_words, numbers, "bigint") == [brute.malay(n) for n in numbers]


def test_spoken_values(apply):
    assert apply(N.malay_currency, [1234.5, 70.0], "double") == [
        "seribu dua ratus tiga puluh empat ringgit lima puluh sen",
        "tujuh puluh ringgit",
    ]
    assert apply(N.malay_percent, [15.5, 8.1, 70.0], "double") == [
        "lima belas perpuluhan lima peratus",
        "lapan perpuluhan kosong peratus",
        "tujuh puluh peratus",
    ]
    assert apply(N.malay_year, [2024, 2000, 1999], "int") == [
        "dua ribu dua puluh empat",
        "dua ribu",
        "seribu sembilan ratus sembilan puluh sembilan",
    ]
    assert apply(N.malay_spell_digits, ["012-345-6789"]) == [
        "kosong satu dua tiga empat lima enam tujuh lapan sembilan"
    ]
    assert apply(N.malay_ordinal, [1, 10, 11], "int") == ["pertama", "kesepuluh", "ke sebelas"]


def test_numbers_in_text(apply, spark):
    cases = [
        "Harga RM 15 sahaja",
        "RM 1234 dan RM 1,234.50",
        "15% 12.5 % 3.0%",
        "RM 12%",
        "RM5%RM 6.05",
        "a5 5a 5-6 1,2 1,234,567.80",
        "versi 2.0.1, 233.233.171.252",
        "2123465659789240 007",
        "RM 1,2345 x",
        " ",
    ]
    assert apply(lambda c: N.normalize_numbers(c, "ms"), cases) == [brute.malay_numbers(c) for c in cases]
    rng = random.Random(3)
    parts = ["RM", "RM ", "1", "23", "456", ",", ".", "%", " %", " ", "x", "1,234", "0.50", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(12)) for _ in range(400)]
    assert apply(lambda c: N.normalize_numbers(c, "ms"), texts) == [brute.malay_numbers(t) for t in texts]
    docs = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert apply(lambda c: N.normalize_numbers(c, "ms"), docs) == [brute.malay_numbers(t) for t in docs]
    english = apply(lambda c: N.normalize_numbers(c, "en"), ["RM 1,234.50", "12.50 kg", "3.00", "15%"])
    assert english == [
        "one thousand, two hundred and thirty-four ringgit fifty sen",
        "twelve point five kg",
        "three",
        "fifteen percent",
    ]
    chinese = apply(lambda c: N.normalize_numbers(c, "zh"), ["价格是 15元", "增长 15%", "增长 2.5%", "第1名 1.50"])
    assert chinese == ["价格是 十五元", "增长 百分之十五", "增长 二点五%", "第1名 一点五零"]


def test_tidying_leaves_single_blanks_alone(apply):
    texts = ["satu dua tiga", "satu  dua", "a\tb c", " a\u3000\u3000 b\x85", "é\xa0ü", ""]
    assert apply(lambda c: F.regexp_count(c, F.lit(expr.LOOSE)), texts) == [0, 1, 1, 2, 1, 0]
    assert apply(expr.squeeze, texts) == ["satu dua tiga", "satu dua", "a b c", "a b", "é ü", ""]


def test_numbers_of_every_length(apply):
    """Up to three digits, up to six and up to nine go ways of their own."""
    rng = random.Random(7)
    digits = [f"{rng.randrange(10**k):0{k}d}" for k in range(1, 31) for _ in range(20)] + ["0", "000", "1000", "001000", "100000", "1000000"]
    assert apply(lambda c: N.normalize_numbers(c, "ms"), digits) == [brute.malay_numbers(d) for d in digits]
    fast = apply(N.english_digits_to_words, ["0", "12", "1000", "1001", "1100", "999999", "007", "001000"])
    assert fast[:4] == ["zero", "twelve", "one thousand", "one thousand and one"]
    assert fast[4:] == [
        "one thousand, one hundred", "nine hundred and ninety-nine thousand, nine hundred and ninety-nine", "seven", "one thousand",
    ]


def test_preparation_order(apply):
    text = "Dr. Siti beli 5 kg, RM 25.50 laah!  15%"
    assert apply(lambda c: asr.preprocess_asr(c, "ms"), [text]) == [
        "doktor. siti beli lima kilogram, dua puluh lima ringgit lima puluh sen lah! lima belas peratus"
    ]
    assert apply(lambda c: asr.preprocess_asr(c, "en", clean_for_asr=True), ["Mr. X (no) @ 3’s"]) == [
        "mister x number @ three's"
    ]
    assert apply(lambda c: asr.preprocess_asr(c, "fr"), ["Dr No 5"]) == ["dr no five"]


def test_repetition_against_brute_force(apply, spark):
    rng = random.Random(9)
    words = ["ja", "Ja!", "ja,", "kata", "dua", "xyz", "uuuuuuuuuuuuu", "...........", "a", "嗯", "嗯嗯嗯嗯嗯嗯嗯嗯嗯嗯嗯嗯", "!!"]
    texts = ["", "   ", "no loop here at all", "x" * 30, "abcabcabcabcabcabcabcabcabcabcabcabcabc", "end" + "." * 12]
    for _ in range(400):
        out = []
        for _ in range(rng.randrange(1, 8)):
            out += [rng.choice(words) for _ in range(rng.randrange(1, 4))] * rng.choice([1, 1, 1, 4, 7])
        texts.append(rng.choice([" ", ", ", "  "]).join(out))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts += [r[0] for r in docs]
    got = [tuple(r) for r in apply(repetition.detect_repetition, texts)]
    assert got == [brute.looping(t) for t in texts]


LONG_LOOPS = {
    "e": "e",
    "xy": "xy",
    "ja, ": "ja",
    "kata ": "kata",
    "kata dua ": "kata dua",
    "Ja! jA ": "Ja! jA",
    "嗯": "嗯",
    ".": ".",
}


def test_long_loops_need_no_stack():
    """In a session of its own, as a warm one forgives more."""
    import subprocess
    import sys

    code = f"""
from pyspark.sql import functions as F
from tuturan.functions.repetition import detect_repetition
from tuturan.session import local_session
spark = local_session("2", "cold")
words = " ".join(f"w{{k}}" for k in range(60))
rows = [(k, words + " " + unit * 100_000) for k, unit in enumerate({list(LONG_LOOPS)!r})]
got = spark.createDataFrame(rows, "k int, t string").select("k", detect_repetition(F.col("t")).alias("r")).orderBy("k").collect()
print([(r["r"]["flagged"], r["r"]["cleaned"].startswith("w0 w1"), len(r["r"]["cleaned"]) < 400) for r in got])
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith(str([(True, True, True)] * len(LONG_LOOPS))), out.stderr[-3000:]


def test_window_of_the_loop_search(apply):
    text = ["b" * 3 + "ok go " * 30 + "xyz" * 12]
    whole = apply(repetition.detect_repetition, text)[0]
    near = apply(lambda c: repetition.detect_repetition(c, window=10), text)[0]
    assert whole["flagged"] and near["flagged"] and whole["cleaned"] != near["cleaned"]


def test_scoring_normalisers(apply):
    assert apply(S.scoring_text_ms, [" Suhu 5², Ya-lah - itu!  "]) == ["suhu 5dua ya-lah itu"]
    assert apply(S.scoring_text_zh, ["你好， A b"]) == ["你 好 a b"]
    assert apply(S.fold_compounds, ["Touch n Go e-wallet, PIN number"]) == ["touchngo ewallet, pinnumber"]


def test_language(apply):
    assert apply(L.detect_language, ["saya nak pergi", "hello there", "你好 ok", "Saya ok"]) == ["ms", "en", "zh", "en"]
    tagged = apply(lambda c: L.tag_text(F.lit("x"), c), ["ms", "fr", "zh"])
    assert tagged == ["<|ms|> x", "<|en|> x", "<|zh|> x"]
    runs = apply(L.language_runs, ["  Saya ada meeting, ok! nanti", "!! hello", "", "   "])
    assert [[tuple(p) for p in r] for r in runs] == [
        [("ms", "Saya ada"), ("en", "meeting, ok!"), ("ms", "nanti")],
        [("ms", "!! hello")],
        [],
        [],
    ]
    groups = apply(L.word_runs, ["saya ada Meeting, email nanti"])
    assert [tuple(p) for p in groups[0]] == [(False, "saya ada"), (True, "Meeting, email"), (False, "nanti")]


def test_word_errors_against_dynamic_programming(apply, spark):
    rng = random.Random(2)
    draw = lambda: " ".join(rng.choice("a b c d é 好".split()) for _ in range(rng.randrange(0, 12)))
    pairs = [(draw(), draw()) for _ in range(300)] + [("the cat sat on the mat", "the cat sit on mat now"), ("a b", ""), ("", "")]
    big = " ".join(f"w{i}" for i in range(400))
    pairs.append((big, big.replace("w7 ", "").replace("w300", "zz")))
    rows = spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(pairs)], "i int, r string, h string")
    ops = arrow.edit_operations(F.col("r"), F.col("h"))
    out = rows.select("i", S.word_errors(F.col("r"), F.col("h")).alias("e"), ops.alias("o")).orderBy("i").collect()
    for (ref, hyp), row in zip(pairs, out):
        distance, subs = brute.edit_cost(ref.split(), hyp.split())
        assert row["e"] == distance
        assert row["o"]["substitutions"] == subs
        assert row["o"]["substitutions"] + row["o"]["insertions"] + row["o"]["deletions"] == distance
        assert row["o"]["hits"] + row["o"]["substitutions"] + row["o"]["deletions"] == len(ref.split())
        assert row["o"]["hits"] + row["o"]["substitutions"] + row["o"]["insertions"] == len(hyp.split())


def test_map_text_and_scorer_hook(apply, spark):
    assert apply(lambda c: arrow.map_text(lambda t: t.str.title(), c), ["a b", None]) == ["A B", None]
    rows = spark.createDataFrame([(i, "bad" if i == 4 else f"t{i}") for i in range(10)], "i int, t string")

    def scorer(items):
        if "bad" in items:
            raise ValueError("bad item")
        return [x.upper() for x in items]

    kept = arrow.score_batches(rows, scorer, "t", batch_size=3)
    assert {r["i"]: r["predicted"] for r in kept.collect()} == {i: "" if i == 4 else f"T{i}" for i in range(10)}
    assert arrow.score_batches(rows, scorer, "t", on_error=None).count() == 9
    told = arrow.score_batches(rows, scorer, "t", batch_size=3, error="why")
    assert told.where("why is not null").count() == 1


def test_marks_in_a_text_are_put_back(apply):
    """The mark around matches is doubled where a text holds it, so no part is taken for a match."""
    texts = ["\uffff dr. a \uffff\uffff", "dr\uffffdr", "\uffff", "", None, "no dr", "xdr"]
    assert apply(lambda c: X.expand_abbreviations(c, "en"), texts) == [
        "\uffff doctor. a \uffff\uffff", "doctor\uffffdoctor", "\uffff", "", None, "number doctor", "xdr",
    ]


def test_word_errors_of_many_distinct_words(spark):
    """More than 127 distinct words, against a plain table; every word counts one."""
    ref = [f"w{i}" for i in range(300)]
    hyp = ["zz" if (32 + i) % 5 == 0 else w for i, w in enumerate(ref) if (32 + i) % 23]
    row = list(range(len(hyp) + 1))
    for i, a in enumerate(ref):
        new = [i + 1]
        for j, b in enumerate(hyp):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    pair = spark.createDataFrame([(" ".join(ref), " ".join(hyp))], "r string, h string")
    from tuturan.functions import scoring

    assert pair.select(scoring.word_errors(F.col("r"), F.col("h"))).first()[0] == row[-1] == 71
