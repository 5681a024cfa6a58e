"""Detector of looping transcripts, six rules in order, on the whole text.

Every rule is one search without an open-ended group, so a loop of any length is found in constant
stack, and the text before it is cut from what the search returned.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tuturan.functions.expr import SPACE, WORD, let, strip, words_of

# --- fixed values: a run must be longer than this ----------------------------------------------------
RUN = 10
LOOPING_CHARACTER = r"[^\x00-\x7F]|[aeiou.]"
LISTED = 5


def detect_repetition(col: Column, max_repetitions: int = 3, window: int | None = None) -> Column:
    """struct(cleaned, flagged): the text up to the loop, and whether a loop was found.

    ``window`` limits the places at which loops of one to four characters of any kind may begin;
    without it they are sought in the whole text. What a search returns stands for the first time
    where it was found, so its place needs no second search.
    """

    def result(cleaned: Column, flagged: bool = True) -> Column:
        return F.struct(cleaned.alias("cleaned"), F.lit(flagged).alias("flagged"))

    def or_else(text: Column, other: Column) -> Column:
        return F.coalesce(F.nullif(text, F.lit("")), other)

    def found(text: Column, pattern: str, then, otherwise: Column) -> Column:
        """``then`` of what the pattern finds, or the next rule; a null text is not searched."""
        part = F.regexp_extract(text, pattern, 0)
        return let(part, lambda m: F.when(m != "", then(m)).otherwise(otherwise))

    def before(text: Column, part: Column) -> Column:
        return F.substr(text, F.lit(1), F.instr(text, part) - 1)

    def rules(text: Column, words: Column, joined: Column, plain: Column) -> Column:
        outcome = found(
            F.when(F.regexp_count(text, F.lit(r"\.")) > RUN, text),
            rf"\.{{{RUN},}}",
            lambda m: result(strip(before(text, m))),
            result(text, False),
        )

        def padded(words_text: Column) -> Column:
            return F.concat(F.lit(" "), words_text, F.lit(" "))

        def first_words(m: Column) -> Column:
            spaces = F.regexp_count(F.substr(padded(plain), F.lit(1), F.instr(padded(plain), m)), F.lit(" "))
            return result(F.array_join(F.slice(words, F.lit(1), spaces), " "))

        same = rf" ([^ ]++)(?: \1){{{max_repetitions * 2}}} "
        outcome = found(F.when(F.size(words) > 5, padded(plain)), same, first_words, outcome)

        def first_phrase(m: Column) -> Column:
            size = F.floor((F.length(m) - max_repetitions - 2) / (max_repetitions + 1))
            end = F.instr(padded(joined), m) + size - 1
            return result(F.substr(joined, F.lit(1), end.cast("int")))

        phrase = rf" ([^ ]++(?: [^ ]++){{0,8}}?)(?: \1){{{max_repetitions}}} "
        outcome = found(F.when(F.size(words) > 3, padded(joined)), phrase, first_phrase, outcome)

        listed = rf"((?<!{WORD}){WORD}{{1,5}}(?!{WORD}))(?:,{SPACE}*\1){{{LISTED}}}"

        def frequent(word: Column) -> Column:
            mark = F.concat(word, F.lit(","))
            rest = F.substr(text, F.instr(text, mark))
            count = (F.length(rest) - F.length(F.replace(rest, mark, F.lit("")))) / F.length(mark)
            return count > max_repetitions

        following = outcome
        candidates = F.regexp_extract_all(text, F.lit(listed), F.lit(1))
        outcome = let(
            F.get(F.filter(candidates, frequent), 0),
            lambda word: F.when(
                word.isNotNull(), result(or_else(strip(before(text, F.concat(word, F.lit(",")))), word))
            ).otherwise(following),
        )

        def character_loop(size: int):
            return lambda m: result(or_else(strip(before(text, m)), F.left(m, F.lit(size))))

        for size in (4, 3, 2, 1):
            near = text if window is None else F.left(text, F.lit(window - 1 + size * (RUN + 1)))
            loop = rf"(?s)({'.' * size})\1{{{RUN}}}"
            outcome = found(near, loop, character_loop(size), outcome)
        run = rf"({LOOPING_CHARACTER})\1{{{RUN}}}"
        return found(F.when(F.length(text) > 20, text), run, character_loop(1), outcome)

    def prepared(text: Column) -> Column:
        words = words_of(text)
        split = F.struct(text.alias("text"), words.alias("words"), F.array_join(words, " ").alias("joined"))
        plain = lambda p: F.regexp_replace(F.lower(p["joined"]), r"[^\p{L}\p{N}_ ]", "")
        return let(
            split,
            lambda p: let(plain(p), lambda x: rules(p["text"], p["words"], p["joined"], x)),
        )

    return let(col, prepared)
