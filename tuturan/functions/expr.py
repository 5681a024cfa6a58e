"""Small Column helpers shared by the text functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

# Character classes with the meaning they have in Unicode-aware text tools. The letter beyond the
# basic plane, spelled out, makes Java look behind by code points instead of by UTF-16 units.
WORD = "[\\p{L}\\p{N}_\U00010000]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE_SET = r"\s\x1c-\x1f\x85\p{Z}"
SPACE = rf"[{SPACE_SET}]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
# White space other than a single blank; plain characters take one test.
LOOSE = rf"(?=[^!-~])(?:{SPACE}{{2,}}|[{SPACE_SET}&&[^ ]])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may use it many times."""
    return F.transform(F.array(value), body).getItem(0)


def fold(col: Column, steps: Iterable[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) pairs in order."""
    for pattern, replacement in steps:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def strip(col: Column) -> Column:
    """Trim every kind of Unicode white space from both ends."""
    return F.regexp_replace(col, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(col: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(col, LOOSE, " "))


def is_blank(col: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(~col.rlike(rf"[^{SPACE_SET}]"), F.lit(True))


def words_of(col: Column) -> Column:
    """White-space split without empty words."""
    return F.filter(F.split(col, rf"{SPACE}+", -1), lambda w: w != "")


def table_literal(rows: list[str]) -> Column:
    """A constant array of strings, one literal for the whole table (no row holds a tab)."""
    return F.split(F.lit("\t".join(rows)), "\t")


# No character: texts do not hold it, and where one does it is doubled and put back.
_MARK = "\uffff"


def replace_matches(
    col: Column,
    pattern: str,
    spell: Callable[[Column], Column],
    unless: Callable[[Column], tuple[Column, Callable[[Column], Column]]] | None = None,
) -> Column:
    """Replace every match of ``pattern`` by ``spell(match)``; the text between stays.

    One scan puts a mark around every match, so every second part between marks is one. No match may
    be empty. ``unless`` may look at the found matches and name a condition with another way to go.
    """

    def rebuild(p: Column) -> Column:
        text, parts = p["text"], p["parts"]
        odd = lambda i: (i % 2) == 1

        def one(part: Column, i: Column) -> Column:
            return F.when(~odd(i), part).when(part == "", _MARK).otherwise(spell(part))

        untouched = F.when(F.size(parts) == 1, text)
        if unless is not None:
            condition, other = unless(F.filter(parts, lambda part, i: odd(i) & (part != "")))
            untouched = untouched.when(condition, other(text))
        return untouched.otherwise(F.array_join(F.transform(parts, one), ""))

    def cut(text: Column) -> Column:
        whole = F.replace(text, F.lit(_MARK), F.lit(_MARK * 2))
        return F.split(F.regexp_replace(whole, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)

    return let(
        col,
        lambda t: let(
            F.struct(t.alias("text"), cut(t).alias("parts")),
            lambda p: F.when(p["text"].isNotNull(), rebuild(p)),
        ),
    )


def java_edges(pattern: str) -> str:
    r"""Rewrite ``\b`` and ``\s`` of a plain pattern as explicit Unicode tests."""
    head = rf"(?<!{WORD})"
    if pattern.startswith(r"\b"):
        pattern = head + pattern[2:]
    return pattern.replace(r"\b", EDGE)
