"""Normalisers and error counts for comparing a hypothesis with its reference."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tuturan.functions.arrow import long_text_distance
from tuturan.functions.expr import SPACE, SPACE_SET, WORD, fold, let, words_of

LONG_PAIR = 1_000_000  # cells of a table of two texts

# --- fixed values: superscript digits ---------------------------------------------------------------
SUPERSCRIPTS = [("¹", "satu"), ("²", "dua"), ("³", "tiga")]

# --- fixed values: characters dropped before scoring -----------------------------------------------
SCORING_IGNORED = r"""/:\\;"\u2212*`\u2011\u2015'\u201e~\xAB\xBB\u2013\u2014\u2026\[\]()\t\r\n!?,."""
CHINESE_IGNORED = "，。！？、：；\"（）【】《》"

# --- fixed values: compound words, applied in this order ------------------------------------------
COMPOUND_WORDS = [
    ("duit now", "duitnow"),
    ("may bank", "maybank"),
    ("cimb clicks", "cimbclicks"),
    ("touch n go", "touchngo"),
    ("touch and go", "touchngo"),
    ("e wallet", "ewallet"),
    ("e-wallet", "ewallet"),
    ("m banking", "mbanking"),
    ("m-banking", "mbanking"),
    ("i banking", "ibanking"),
    ("i-banking", "ibanking"),
    ("pin number", "pinnumber"),
    ("pin kod", "pinkod"),
    ("atm card", "atmcard"),
    ("debit card", "debitcard"),
    ("credit card", "creditcard"),
    ("bank account", "bankaccount"),
    ("ic number", "icnumber"),
    ("i c", "ic"),
    ("n r i c", "nric"),
    ("nric number", "nricnumber"),
]


def scoring_text_ms(col: Column) -> Column:
    """Superscripts to words, lower case, punctuation and lone hyphens to blanks."""
    text = col
    for mark, word in SUPERSCRIPTS:
        text = F.replace(text, F.lit(mark), F.lit(word))
    return fold(
        F.lower(text),
        [
            (f"[{SCORING_IGNORED}]", " "),
            (rf"(?<!{WORD})-(?!{WORD})", " "),
            (rf"[^\p{{L}}\p{{N}}_{SPACE_SET}\-]", " "),
            (rf"\A{SPACE}+|{SPACE}+\z", ""),
            (rf"{SPACE}{{2,}}", " "),
        ],
    )


def fold_compounds(col: Column) -> Column:
    """Spaced spellings of product names become one word; the text is lower-cased."""
    text = F.lower(col)
    for spaced, joined in COMPOUND_WORDS:
        text = F.replace(text, F.lit(spaced), F.lit(joined))
    return text


def scoring_text_zh(col: Column) -> Column:
    """One token per character, punctuation and white space dropped."""
    kept = F.regexp_replace(col, f"[{CHINESE_IGNORED}{SPACE_SET}]+", "")
    return F.lower(F.array_join(F.split(kept, ""), " "))


def scoring_text(col: Column, language: Column | str = "ms") -> Column:
    """The normaliser of a language; everything but ``zh`` uses the word-based one."""
    by_word = fold_compounds(scoring_text_ms(col))
    if isinstance(language, str):
        return scoring_text_zh(col) if language == "zh" else by_word
    return F.when(language == "zh", scoring_text_zh(col)).otherwise(by_word)


def _unlike(ref: Column, hyp: Column) -> Column:
    """1-based place of the first words that differ; one list may end there."""
    return F.array_position(F.zip_with(ref, hyp, lambda a, b: ~a.eqNullSafe(b)), True).cast("int")


def _middle(ref: Column, hyp: Column) -> Column:
    """Both word lists, which differ, without their common beginning and end."""

    def cut_end(p: Column) -> Column:
        r, h = p["ref"], p["hyp"]
        keep = lambda words, e: F.slice(words, F.lit(1), F.size(words) - e)
        return let(
            _unlike(F.reverse(r), F.reverse(h)) - 1,
            lambda e: F.struct(keep(r, e).alias("ref"), keep(h, e).alias("hyp")),
        )

    def cut_start(at: Column) -> Column:
        rest = lambda words: F.slice(words, at, F.greatest(F.size(words) - at + 1, F.lit(0)))
        return let(F.struct(rest(ref).alias("ref"), rest(hyp).alias("hyp")), cut_end)

    return let(_unlike(ref, hyp), cut_start)


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """Word edit distance, whole texts: the words between the common beginning and end become code
    points, then ``levenshtein``."""

    def encode(words: Column, known: Column) -> Column:
        place = lambda w: F.array_position(known, w)
        code = lambda p: F.when(p < 0xD000, p).otherwise(p + 0x10000)
        hexed = F.transform(words, lambda w: F.lpad(F.hex(code(place(w))), 8, "0"))
        return F.decode(F.unhex(F.array_join(hexed, "")), "UTF-32")

    def between(ref: Column, hyp: Column) -> Column:
        coded = let(
            F.array_distinct(F.concat(ref, hyp)),
            lambda known: F.levenshtein(encode(ref, known), encode(hyp, known)),
        )
        one_sided = (F.size(ref) == 0) | (F.size(hyp) == 0)
        return F.when(one_sided, F.size(ref) + F.size(hyp)).otherwise(coded)

    def distance(pair: Column) -> Column:
        return let(_middle(pair["ref"], pair["hyp"]), lambda m: between(m["ref"], m["hyp"]))

    pair = F.struct(
        words_of(F.coalesce(reference, F.lit(""))).alias("ref"),
        words_of(F.coalesce(hypothesis, F.lit(""))).alias("hyp"),
    )
    errors = let(
        pair,
        lambda p: F.when(p["ref"] == p["hyp"], 0)
        .when((F.size(p["ref"]) == 0) | (F.size(p["hyp"]) == 0), F.size(p["ref"]) + F.size(p["hyp"]))
        .otherwise(distance(p)),
    )
    return errors.cast("bigint")


def word_count(col: Column) -> Column:
    return F.size(words_of(F.coalesce(col, F.lit("")))).cast("bigint")


def char_errors(reference: Column, hypothesis: Column) -> Column:
    """Character edit distance of the whole texts.

    Long pairs go to a distance whose work grows with the errors instead of with the product of the
    lengths; it needs a projection of its own, so not inside a lambda.
    """
    ref, hyp = F.coalesce(reference, F.lit("")), F.coalesce(hypothesis, F.lit(""))
    long = F.length(ref).cast("bigint") * F.length(hyp) > LONG_PAIR
    far = long_text_distance(F.when(long, ref), F.when(long, hyp))
    return F.coalesce(F.when(~long, F.levenshtein(ref, hyp)).cast("bigint"), far)


def error_rate(errors: Column, total: Column) -> Column:
    """errors / total, null for an empty reference."""
    return F.when(total > 0, errors / total)
