"""The complete transcript preparation, composed from the single functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tuturan.functions.arrow import nfc
from tuturan.functions.expr import is_blank, let, squeeze
from tuturan.functions.numbers import normalize_numbers
from tuturan.functions.text import (
    clean_for_asr as keep_allowed,
    expand_abbreviations,
    normalize_characters,
    normalize_particles,
    preprocess_zh,
    remove_punctuation as drop_punctuation,
)


def preprocess_asr(
    col: Column,
    language: Column | str,
    lowercase: bool = True,
    unicode_normalize: bool = True,
    characters: bool = True,
    abbreviations: bool = True,
    particles: bool = True,
    numbers: bool = True,
    remove_punctuation: bool = False,
    clean_for_asr: bool = False,
) -> Column:
    """NFC, characters, abbreviations, numbers, particles, lower case, clean-up, white space.

    ``zh`` goes through the Chinese steps. A language column is read as ``spoken_language`` gives
    it (ms, zh, everything else en); a language named as a string that is none of en/ms/zh gets
    only the steps that do not depend on a language. Blank text is returned as it is.
    """

    def spoken(text: Column, code: str) -> Column:
        if characters:
            text = normalize_characters(text)
        if abbreviations and code in ("en", "ms"):
            text = expand_abbreviations(text, code)
        if numbers:
            text = normalize_numbers(text, code, tidy=False)
        if particles and code in ("en", "ms"):
            text = normalize_particles(text)
        if lowercase:
            text = F.lower(text)
        if clean_for_asr:
            text = keep_allowed(text)
        elif remove_punctuation:
            text = drop_punctuation(text)
        return squeeze(text)

    chinese = preprocess_zh(col, punctuation=remove_punctuation or clean_for_asr)
    base = nfc(col) if unicode_normalize else col
    if isinstance(language, str):
        done = chinese if language == "zh" else let(base, lambda t: spoken(t, language))
    else:
        done = F.when(language == "zh", chinese).otherwise(
            let(
                base,
                lambda t: F.when(language == "ms", spoken(t, "ms")).otherwise(spoken(t, "en")),
            )
        )
    return F.when(is_blank(col), col).otherwise(done)
