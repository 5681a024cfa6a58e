"""Text clean-up as Column functions: markers, characters, scripts, abbreviations, particles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tuturan.functions.arrow import nfc
from tuturan.functions.expr import (
    NOT_WORD,
    SPACE_SET,
    fold,
    is_blank,
    java_edges,
    replace_matches,
    squeeze,
)

# --- fixed values: tagged transcripts -------------------------------------------------------
MARKER = r"<\|[^|]*\|>"
LANGUAGE_MARKER = r"<\|([a-z]{2})\|>"
TIME_MARKER = r"<\|(\d+\.\d+)\|>"

# --- fixed values: single character replacements ----------------------------------------------
QUOTES_DOUBLE = "\u201c\u201d\u201e\u201f"
QUOTES_SINGLE = "\u2018\u2019\u201a\u201b\u0060\u00b4"
DASHES = "\u2014\u2013\u2212\u2010\u2011\u2012\u2015"
SPACES = "\u00a0\u2002\u2003\u2009"
DELETED = "\u200b\u200c\u200d\ufeff\u200e\u200f"
ELLIPSIS = "\u2026"

# --- fixed values: emoji ranges -----------------------------------------------------------------
EMOJI_RANGES = [
    (0x1F600, 0x1F64F),
    (0x1F300, 0x1F5FF),
    (0x1F680, 0x1F6FF),
    (0x1F700, 0x1F77F),
    (0x1F780, 0x1F7FF),
    (0x1F800, 0x1F8FF),
    (0x1F900, 0x1F9FF),
    (0x1FA00, 0x1FA6F),
    (0x1FA70, 0x1FAFF),
    (0x2702, 0x27B0),
    (0x1F1E0, 0x1F1FF),
    (0x2600, 0x26FF),
    (0x2B50, 0x2B55),
    (0x231A, 0x231B),
    (0xFE0F, 0xFE0F),
]

# --- fixed values: script ranges ------------------------------------------------------------------
SCRIPT_RANGES = {
    "chinese": [(0x4E00, 0x9FFF), (0x3400, 0x4DBF)],
    "tamil": [(0x0B80, 0x0BFF)],
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F)],
    "thai": [(0x0E00, 0x0E7F)],
    "cyrillic": [(0x0400, 0x04FF)],
    "japanese": [(0x3040, 0x309F), (0x30A0, 0x30FF)],
    "korean": [(0xAC00, 0xD7AF), (0x1100, 0x11FF)],
    "devanagari": [(0x0900, 0x097F)],
    "bengali": [(0x0980, 0x09FF)],
    "telugu": [(0x0C00, 0x0C7F)],
    "hebrew": [(0x0590, 0x05FF)],
    "greek": [(0x0370, 0x03FF)],
}

# --- fixed values: characters allowed in a transcript --------------------------------------------
ALLOWED = r"a-zA-Z0-9'\-@\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}\x{100}-\x{17F}"
NOT_ALLOWED = rf"[^{ALLOWED}{SPACE_SET}]"

# --- fixed values: abbreviations, applied in this order -------------------------------------------
ABBREVIATIONS = {
    "en": [
        (r"\bdr\.?\b", "doctor"),
        (r"\bmr\.?\b", "mister"),
        (r"\bmrs\.?\b", "missus"),
        (r"\bms\.?\b", "miss"),
        (r"\bprof\.?\b", "professor"),
        (r"\bkm\b", "kilometers"),
        (r"\bkg\b", "kilograms"),
        (r"\bmm\b", "millimeters"),
        (r"\bcm\b", "centimeters"),
        (r"\bml\b", "milliliters"),
        (r"\bhr\b", "hour"),
        (r"\bhrs\b", "hours"),
        (r"\bmin\b", "minutes"),
        (r"\bsec\b", "seconds"),
        (r"\betc\.?\b", "et cetera"),
        (r"\be\.g\.?\b", "for example"),
        (r"\bi\.e\.?\b", "that is"),
        (r"\bvs\.?\b", "versus"),
        (r"\bno\.?\b", "number"),
        (r"\bst\b", "street"),
        (r"\bave\b", "avenue"),
        (r"\brd\b", "road"),
        (r"\bapt\b", "apartment"),
    ],
    "ms": [
        (r"\bdr\.?\b", "doktor"),
        (r"\ben\.?\b", "encik"),
        (r"\bpn\.?\b", "puan"),
        (r"\bcik\.?\b", "cik"),
        (r"\bprof\.?\b", "profesor"),
        (r"\bdato'?\.?\b", "dato"),
        (r"\bdatuk\.?\b", "datuk"),
        (r"\btan sri\.?\b", "tan sri"),
        (r"\btun\.?\b", "tun"),
        (r"\bkm\b", "kilometer"),
        (r"\bkg\b", "kilogram"),
        (r"\bmm\b", "milimeter"),
        (r"\bcm\b", "sentimeter"),
        (r"\bml\b", "mililiter"),
        (r"\bjam\b", "jam"),
        (r"\bmin\b", "minit"),
        (r"\bsaat\b", "saat"),
        (r"\bdll\.?\b", "dan lain-lain"),
        (r"\bdsb\.?\b", "dan sebagainya"),
        (r"\byg\b", "yang"),
        (r"\bdgn\b", "dengan"),
        (r"\butk\b", "untuk"),
        (r"\bkpd\b", "kepada"),
        (r"\bdrpd\b", "daripada"),
        (r"\bsdh\b", "sudah"),
        (r"\bblm\b", "belum"),
        (r"\btdk\b", "tidak"),
        (r"\bbrp\b", "berapa"),
        (r"\bjln\b", "jalan"),
        (r"\btmn\b", "taman"),
        (r"\bkaw\b", "kawasan"),
    ],
}

# --- fixed values: discourse particles, applied in this order --------------------------------------
PARTICLES = [
    (r"\blaa+h?\b", "lah"),
    (r"\bla+\b", "lah"),
    (r"\blor\b", "lah"),
    (r"\ble+h\b", "leh"),
    (r"\ble+\b", "leh"),
    (r"\blo+h\b", "loh"),
    (r"\blo+r\b", "loh"),
    (r"\blo+\b", "loh"),
    (r"\ba+h\b", "ah"),
    (r"\bar+h?\b", "ah"),
    (r"\bme+h\b", "meh"),
    (r"\bho+r\b", "hor"),
    (r"\bka+n\b", "kan"),
    (r"\bya+h?\b", "ya"),
]

# --- fixed values: Chinese corpora --------------------------------------------------------------------
NOISE_TAGS = [
    "<SPOKEN_NOISE>",
    "[SPOKEN_NOISE]",
    "[noise]",
    "[laughter]",
    "[cough]",
    "[breath]",
    "<UNK>",
    "[UNK]",
]
CHINESE_PUNCTUATION = "。，、；：？！\"「」『』（）【】〔〕《》〈〉—…·"

# --- fixed values: abbreviations written for speech synthesis -----------------------------------------
SPEECH_ABBREVIATIONS = {
    "yg": "yang",
    "utk": "untuk",
    "dgn": "dengan",
    "kpd": "kepada",
    "dlm": "dalam",
    "sbb": "sebab",
    "mcm": "macam",
    "org": "orang",
    "nk": "nak",
    "tk": "tak",
    "x": "tidak",
    "dr": "dari",
    "bg": "bagi",
    "sgt": "sangat",
    "lg": "lagi",
    "je": "sahaja",
    "ja": "sahaja",
    "apa2": "apa-apa",
    "bila2": "bila-bila",
    "mana2": "mana-mana",
}


def char_class(ranges: list[tuple[int, int]]) -> str:
    """A regex class from code point ranges, behind one cheap test that most characters fail."""
    body = "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in ranges)
    return rf"(?=[\x{{{min(lo for lo, _ in ranges):X}}}-\x{{10FFFF}}])[{body}]"


# ---------------------------------------------------------------------------------------- markers
def strip_markers(col: Column) -> Column:
    """Delete ``<|…|>`` tags and squeeze white space."""
    return squeeze(F.regexp_replace(col, MARKER, ""))


def marker_language(col: Column) -> Column:
    """First two-letter tag, ``unknown`` when there is none."""
    found = F.regexp_extract(col, LANGUAGE_MARKER, 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown"))


def marker_duration(col: Column) -> Column:
    """Last ``<|seconds|>`` tag, 0.0 when there is none."""
    times = F.regexp_extract_all(col, F.lit(TIME_MARKER), F.lit(1))
    return F.coalesce(F.try_element_at(times, F.lit(-1)).cast("double"), F.lit(0.0))


# -------------------------------------------------------------------------------------- characters
def normalize_characters(col: Column) -> Column:
    """Typographic quotes, dashes and spaces become plain ones; zero-width characters go."""
    singles = QUOTES_DOUBLE + QUOTES_SINGLE + DASHES + SPACES
    plain = (
        '"' * len(QUOTES_DOUBLE) + "'" * len(QUOTES_SINGLE) + "-" * len(DASHES) + " " * len(SPACES)
    )
    return F.replace(F.translate(col, singles + DELETED, plain), F.lit(ELLIPSIS), F.lit("..."))


def remove_emoji(col: Column) -> Column:
    return F.regexp_replace(col, char_class(EMOJI_RANGES), "")


def contains_script(col: Column, *scripts: str) -> Column:
    """True when the text holds a character of any of the named scripts."""
    ranges = [r for s in scripts for r in SCRIPT_RANGES[s]]
    return col.rlike(char_class(ranges))


def contains_non_latin(col: Column) -> Column:
    return contains_script(col, *SCRIPT_RANGES)


def is_valid_text(col: Column) -> Column:
    """Only letters, digits, blanks and ``' - @``; blank text is not valid."""
    return F.coalesce(col.rlike(rf"\A[{ALLOWED}{SPACE_SET}]+\z"), F.lit(False)) & ~is_blank(col)


def invalid_characters(col: Column) -> Column:
    """Distinct characters outside the allowed set, as a sorted array."""
    found = F.regexp_extract_all(col, F.lit(NOT_ALLOWED), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def clean_for_asr(col: Column) -> Column:
    """Remove emoji and every character outside the allowed set."""
    return squeeze(F.regexp_replace(remove_emoji(col), NOT_ALLOWED, ""))


def remove_punctuation(col: Column, replacement: str = " ") -> Column:
    """Everything but letters, digits, ``_``, white space and the apostrophe."""
    return F.regexp_replace(col, rf"[^\p{{L}}\p{{N}}_{SPACE_SET}']", replacement)


# ---------------------------------------------------------------------- abbreviations and particles
def _either(pairs: list[tuple[str, str]]) -> str:
    """One pattern for all left-hand sides; every one of them starts at a word edge.

    A look at the first two characters comes before the costlier look at the character before them.
    """
    start = java_edges(r"\b")
    heads = [p.removeprefix(r"\b") for p, _ in pairs]
    open_ended = {h[0] for h in heads if h[1] in "+*?"}  # any second character
    first = "".join(sorted({h[0] for h in heads} - open_ended))
    second = "".join(sorted({h[2] if h[1] == "\\" else h[1] for h in heads if h[0] not in open_ended}))
    look = f"[{first}][{second}]" + (f"|[{''.join(sorted(open_ended))}]" if open_ended else "")
    sides = "|".join(java_edges(p)[len(start) :] for p, _ in pairs)
    return f"(?i)(?={look}){start}(?:{sides})"


def _in_order(col: Column, pairs: list[tuple[str, str]]) -> Column:
    return fold(col, [("(?i)" + java_edges(p), r) for p, r in pairs])


def expand_abbreviations(col: Column, language: str = "en") -> Column:
    """Ordered replacement of all abbreviations of a language.

    One scan finds them and each match is looked up. Only text where an abbreviation is glued to
    the next word by its full stop (where the order of the rules shows) is folded rule by rule.
    """
    pairs = ABBREVIATIONS["ms" if language == "ms" else "en"]
    keys = [(re.sub(r"\\b|\\\.|[?']", "", p), r) for p, r in pairs]
    table = F.str_to_map(F.lit(";".join(f"{k}={r}" for k, r in keys)), F.lit(";"), F.lit("="))

    def look_up(found: Column) -> Column:
        return F.element_at(table, F.translate(F.lower(found), ".'", ""))

    def glued(found: Column) -> tuple[Column, Callable[[Column], Column]]:
        return F.exists(found, lambda f: f.rlike("[.']$")), lambda text: _in_order(text, pairs)

    return replace_matches(col, _either(pairs), look_up, glued)


def normalize_particles(col: Column) -> Column:
    """Ordered replacement of all particles; the rules are applied to the found words only."""
    return replace_matches(col, _either(PARTICLES), lambda found: _in_order(found, PARTICLES))


def expand_speech_abbreviations(col: Column) -> Column:
    """Per-word dictionary for synthesis; punctuation after the word is kept."""
    table = F.str_to_map(
        F.lit(",".join(f"{k}:{v}" for k, v in SPEECH_ABBREVIATIONS.items())), F.lit(","), F.lit(":")
    )

    def one(word: Column) -> Column:
        key = F.regexp_replace(F.lower(word), NOT_WORD, "")
        tail = F.regexp_extract(word, rf"{NOT_WORD}+$", 0)
        return F.coalesce(F.concat(F.try_element_at(table, key), tail), word)

    return F.array_join(F.transform(F.split(squeeze(col), " "), one), " ")


# ------------------------------------------------------------------------------------------- Chinese
def fullwidth_to_halfwidth(col: Column) -> Column:
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
    narrow = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
    return F.translate(col, wide, narrow)


def remove_noise_markers(col: Column) -> Column:
    quoted = "|".join(t.replace("[", r"\[").replace("]", r"\]") for t in NOISE_TAGS)
    return F.regexp_replace(col, f"(?i)(?:{quoted})", "")


def remove_chinese_punctuation(col: Column) -> Column:
    return F.translate(col, CHINESE_PUNCTUATION, "")


def preprocess_zh(
    col: Column, punctuation: bool = True, fullwidth: bool = True, noise: bool = True
) -> Column:
    """NFC, noise tags, half width, punctuation, white space; numbers stay as written."""

    def body(raw: Column) -> Column:
        text = remove_noise_markers(raw) if noise else raw
        if fullwidth:
            text = fullwidth_to_halfwidth(text)
        if punctuation:
            text = remove_punctuation(remove_chinese_punctuation(text), "")
        return squeeze(text)

    return F.when(is_blank(col), col).otherwise(body(nfc(col)))
