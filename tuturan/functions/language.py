"""Language heuristics, language tags and word tokenisers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tuturan.functions.expr import NOT_WORD, SPACE, let, strip, words_of
from tuturan.functions.text import SCRIPT_RANGES, SPEECH_ABBREVIATIONS, char_class

# --- fixed values: language tags and keywords --------------------------------------------------------
LANGUAGE_TAGS = {"en": "<|en|>", "ms": "<|ms|>", "zh": "<|zh|>", "id": "<|id|>", "ja": "<|ja|>"}
MALAY_KEYWORDS = [
    "saya", "nak", "pergi", "ke", "tak", "ada", "dengan", "untuk",
    "yang", "ini", "itu", "tidak", "dia", "kita", "kami", "mereka",
    "sudah", "boleh", "juga", "lagi", "bila", "mana", "apa", "siapa",
    "macam", "mau", "mahu", "buat", "tengah", "dekat", "dalam",
]
ENGLISH_IN_SPEECH = [
    "meeting", "report", "email", "deadline", "project", "office",
    "okay", "ok", "sorry", "please", "thanks", "thank", "welcome",
    "phone", "laptop", "computer", "software", "hardware", "online",
    "boss", "manager", "staff", "team", "client", "customer",
    "lunch", "breakfast", "dinner", "coffee", "tea",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]

# --- fixed values: token patterns ---------------------------------------------------------------------
DICTIONARY_TOKEN = rf"[\p{{L}}\p{{N}}_']+|[^\p{{L}}\p{{N}}_\s\x1c-\x1f\x85\p{{Z}}]+|{SPACE}+"
LATIN_TOKEN = rf"[A-Za-z']+|[^\p{{L}}\p{{N}}_\s\x1c-\x1f\x85\p{{Z}}]+|{SPACE}+"
VOCABULARY_PUNCTUATION = r"""[.,!?;:"'\-()\[\]{}\x{2026}\x{AB}\x{BB}\x{2014}\x{2013}]"""


def _constant(words: list[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def detect_language(col: Column, keywords: list[str] = MALAY_KEYWORDS) -> Column:
    """``zh`` when over 30 % of the non-blank characters are Chinese, ``ms`` with two or more
    distinct keywords, else ``en``."""
    chinese = F.regexp_count(col, F.lit(char_class(SCRIPT_RANGES["chinese"])))
    total = F.greatest(F.length(F.replace(col, F.lit(" "), F.lit(""))), F.lit(1))
    return F.when(chinese / total > 0.3, "zh").when(keyword_hits(col, keywords) >= 2, "ms").otherwise("en")


def keyword_hits(col: Column, keywords: list[str] = MALAY_KEYWORDS) -> Column:
    """How many of the keywords occur as words of the text."""
    return F.size(F.array_intersect(F.array_distinct(words_of(F.lower(col))), _constant(keywords)))


def spoken_language(col: Column) -> Column:
    """The normaliser used for a tagged language: ms and id are Malay, zh Chinese, the rest English."""
    return F.when(col.isin("ms", "id"), "ms").when(col == "zh", "zh").otherwise("en")


def tag_text(col: Column, language: Column) -> Column:
    """Prefix the language tag; an unknown language gets the English one."""
    tag = F.lit(LANGUAGE_TAGS["en"])
    for code, mark in LANGUAGE_TAGS.items():
        tag = F.when(language == code, mark).otherwise(tag)
    return F.concat(tag, F.lit(" "), col)


def dictionary_tokens(col: Column) -> Column:
    """Words, punctuation runs and white-space runs, nothing lost."""
    return F.regexp_extract_all(col, F.lit(DICTIONARY_TOKEN), F.lit(0))


def vocabulary_words(col: Column) -> Column:
    """Lower-cased words with punctuation read as a blank."""
    return words_of(F.regexp_replace(F.lower(col), VOCABULARY_PUNCTUATION, " "))


def token_language(token: Column, english: list[str] | None = None) -> Column:
    """``en`` for listed English words; abbreviations and everything else are ``ms``."""
    listed = F.array_contains(_constant(english or ENGLISH_IN_SPEECH), F.lower(token))
    abbreviation = F.array_contains(_constant(list(SPEECH_ABBREVIATIONS)), F.lower(token))
    return F.when(listed, "en").when(abbreviation, "ms").otherwise("ms")


def language_runs(col: Column, english: list[str] | None = None) -> Column:
    """Split text into runs of one language: array of (language, text).

    Latin words decide the language; white space and punctuation stay in the run they are in, and
    punctuation before any word counts as Malay.
    """

    def deciding(tokens: Column) -> Column:
        spoken = F.transform(
            tokens,
            lambda t, i: F.struct(
                (i + 1).alias("start"),
                F.when(t.rlike("^[A-Za-z']"), token_language(t, english))
                .when(~t.rlike(rf"^{SPACE}"), "punctuation")
                .alias("language"),
            ),
        )
        solid = F.filter(spoken, lambda s: s["language"].isNotNull())
        first = lambda s, i: F.struct(
            s["start"].alias("start"),
            F.when((i == 0) & (s["language"] == "punctuation"), "ms")
            .otherwise(s["language"])
            .alias("language"),
        )
        return F.filter(F.transform(solid, first), lambda s: s["language"] != "punctuation")

    def turns(marks: Column) -> Column:
        return F.filter(
            marks, lambda m, i: (i == 0) | (m["language"] != F.get(marks, i - 1)["language"])
        )

    def cut(p: Column) -> Column:
        tokens, runs = p["tokens"], p["runs"]

        def one(run: Column, k: Column) -> Column:
            start = F.when(k == 0, 1).otherwise(run["start"])
            end = F.coalesce(F.get(runs, k + 1)["start"], F.size(tokens) + 1)
            return F.struct(
                run["language"].alias("language"),
                strip(F.array_join(F.slice(tokens, start, end - start), "")).alias("text"),
            )

        return F.transform(runs, one)

    tokens = F.regexp_extract_all(col, F.lit(LATIN_TOKEN), F.lit(0))
    return let(
        tokens,
        lambda t: let(F.struct(t.alias("tokens"), let(deciding(t), turns).alias("runs")), cut),
    )


def word_runs(col: Column, english: list[str] | None = None) -> Column:
    """Consecutive white-space words of the same kind: array of (is_english, text)."""
    listed = _constant(english or ENGLISH_IN_SPEECH)
    flag = lambda w: F.array_contains(listed, F.regexp_replace(F.lower(w), NOT_WORD, ""))

    def runs(words: Column) -> Column:
        flags = F.transform(words, flag)
        return let(
            F.struct(words.alias("words"), flags.alias("flags")),
            lambda p: F.transform(
                F.filter(
                    F.sequence(F.lit(1), F.size(p["words"])),
                    lambda i: (i == 1) | (F.get(p["flags"], i - 1) != F.get(p["flags"], i - 2)),
                ),
                lambda i: F.struct(F.get(p["flags"], i - 1).alias("is_english"), i.alias("start")),
            ),
        )

    def cut(words: Column) -> Column:
        return let(
            F.struct(words.alias("words"), runs(words).alias("runs")),
            lambda p: F.transform(
                p["runs"],
                lambda r, k: F.struct(
                    r["is_english"].alias("is_english"),
                    F.array_join(
                        F.slice(
                            p["words"],
                            r["start"],
                            F.coalesce(F.get(p["runs"], k + 1)["start"], F.size(p["words"]) + 1)
                            - r["start"],
                        ),
                        " ",
                    ).alias("text"),
                ),
            ),
        )

    return let(words_of(col), lambda w: F.when(F.size(w) > 0, cut(w)))
