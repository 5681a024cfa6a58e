"""Template sentences with seeded draws, rounds against earlier batches, quota planning."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tuturan.functions.expr import let, replace_matches, words_of
from tuturan.functions.numbers import malay_digits_to_words, malay_spell_digits
from tuturan.operators.filters import with_text
from tuturan.operators.joins import not_yet_written, text_key
from tuturan.operators.ranks import first_per_key, seeded_sample
from tuturan.session import store

# --- fixed values: draw ranges, names of months, days and parts of the day ----------------------------
AMOUNT_RANGES = [(1, 999), (1000, 99_999), (100_000, 9_999_999), (10_000_000, 999_999_999)]
NUMBER_RANGES = [(1, 100), (100, 10_000), (10_000, 1_000_000), (1_000_000, 100_000_000)]
MONTHS = [
    "Januari", "Februari", "Mac", "April", "Mei", "Jun",
    "Julai", "Ogos", "September", "Oktober", "November", "Disember",
]
DAYS = ["Ahad", "Isnin", "Selasa", "Rabu", "Khamis", "Jumaat", "Sabtu"]
PERIODS = ["pagi", "petang", "malam"]
PHONE_PREFIXES = [
    "010", "011", "012", "013", "014", "015", "016", "017", "018", "019",
    "03", "04", "07", "088", "089", "082", "083", "084", "085",
]
PLATE_LETTERS = ["A", "B", "C", "D"]
CODES = {
    "passport": ("A ", 10_000_000, 99_999_999),
    "ref_number": ("REF ", 100_000, 999_999),
    "reg_number": ("SSM ", 100_000, 999_999),
    "policy_number": ("POL ", 1_000_000, 9_999_999),
    "license_number": ("LIC ", 100_000, 999_999),
    "id_number": ("ID ", 100_000, 999_999),
    "voucher_number": ("VOU ", 10_000, 99_999),
    "serial_number": ("SN ", 100_000, 999_999),
    "invoice_number": ("INV ", 10_000, 99_999),
    "postcode": ("", 10_000, 99_999),
    "receipt_number": ("REC ", 10_000, 99_999),
    "order_number": ("ORD ", 10_000, 99_999),
    "account_number": ("", 1_000_000_000, 9_999_999_999),
}
PLACEHOLDER = r"\{(\w+)\}"
PREVIEW_CHARS = 50
PERSON_FIELDS = ["name", "honorific", "position", "title", "party"]  # what sentences take from a person
SAMPLE_BLOCK = 1000  # samples of one person that stay together when they are dealt out


@dataclass(frozen=True)
class Draws:
    """Seeded draws of one row: the same slot always gives the same value."""

    seed: int
    row: Column

    def between(self, slot: str, low: int, high: int) -> Column:
        text = F.concat_ws("|", F.lit(str(self.seed)), self.row, F.lit(slot))
        number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
        return number % (high - low + 1) + low

    def wide(self, slot: str, low: int, high: int) -> Column:
        """Like ``between`` for ranges above 32 bits."""
        text = F.concat_ws("|", F.lit(str(self.seed)), self.row, F.lit(slot))
        number = F.conv(F.substring(F.md5(text), 1, 14), 16, 10).cast("bigint")
        return number % (high - low + 1) + low

    def choice(self, slot: str, options: Sequence[str]) -> Column:
        table = F.split(F.lit("\t".join(options)), "\t")
        return F.get(table, self.between(slot, 0, len(options) - 1).cast("int"))

    def ranged(self, slot: str, ranges: Sequence[tuple[int, int]]) -> Column:
        """First one of the ranges, then a number in it."""
        kind = self.between(f"{slot}_range", 0, len(ranges) - 1)
        out = None
        for i, (low, high) in enumerate(ranges):
            value = self.between(slot, low, high)
            out = F.when(kind == i, value) if out is None else out.when(kind == i, value)
        return out


# Marks around digits that are spoken as a number or digit by digit once the text is complete.
NUMBER_MARK, DIGITS_MARK = "\u0001", "\u0002"


def _spoken(n: Column) -> Column:
    return F.concat(F.lit(NUMBER_MARK), n.cast("string"), F.lit(NUMBER_MARK))


def _digits(text: Column) -> Column:
    return F.concat(F.lit(DIGITS_MARK), text.cast("string"), F.lit(DIGITS_MARK))


def speak_marked(text: Column) -> Column:
    """Put the words in place of all marked digits; each speller occurs once in the plan."""

    def spoken(text: Column, mark: str, spell: Callable[[Column], Column]) -> Column:
        inside = lambda m: F.substr(m, F.lit(2), F.length(m) - 2)
        return replace_matches(text, rf"{mark}\d+{mark}", lambda m: spell(inside(m)))

    text = spoken(text, NUMBER_MARK, malay_digits_to_words)
    return spoken(text, DIGITS_MARK, malay_spell_digits)


def number_slots(draws: Draws) -> dict[str, Callable[[], Column]]:
    """Every placeholder that stands for a spoken number, with its digits still marked."""
    whole = draws.between
    text = lambda c: c.cast("string")
    two = lambda slot, low, high: F.lpad(text(whole(slot, low, high)), 2, "0")
    clock = lambda hour, minute: F.concat(
        F.lit("pukul "),
        _spoken(whole(hour, 1, 12)),
        F.when(whole(minute, 0, 59) > 0, F.concat(F.lit(" "), _spoken(whole(minute, 0, 59)))).otherwise(""),
    )

    def month_name() -> Column:
        return F.get(F.split(F.lit(" ".join(MONTHS)), " "), (whole("month", 1, 12) - 1).cast("int"))

    def percent() -> Column:
        """One decimal, cut off as a binary fraction."""
        tenths = whole("percent", 5, 995)
        share = tenths / 10.0
        cut = ((share - F.floor(share)) * 10).cast("bigint")
        decimal = F.when(tenths % 10 == 0, "").otherwise(F.concat(F.lit(" perpuluhan "), _spoken(cut)))
        return F.concat(_spoken(F.floor(share)), decimal, F.lit(" peratus"))

    def date() -> Column:
        return F.concat_ws(
            " ", _spoken(whole("day", 1, 28)), month_name(), _spoken(whole("year", 2020, 2025))
        )

    amount = lambda: F.concat(_spoken(draws.ranged("amount", AMOUNT_RANGES)), F.lit(" ringgit"))
    prefix = lambda: draws.choice("prefix", PHONE_PREFIXES)
    slots = {
        "amount": amount,
        "whole_amount": amount,
        "date": date,
        "day": lambda: _spoken(whole("day", 1, 28)),
        "month": lambda: two("month", 1, 12),
        "month_malay": month_name,
        "year": lambda: _spoken(whole("year", 2020, 2025)),
        "day_name": lambda: draws.choice("day_name", DAYS),
        "phone": lambda: _digits(
            F.concat(prefix(), text(whole("phone1", 100, 999)), text(whole("phone2", 1000, 9999)))
        ),
        "prefix": lambda: _digits(prefix()),
        "percent": percent,
        "percentage": percent,
        "number": lambda: _spoken(draws.ranged("number", NUMBER_RANGES)),
        "number1": lambda: _spoken(whole("number1", 1, 1000)),
        "number2": lambda: _spoken(whole("number2", 1, 1000)),
        "time": lambda: clock("hour", "minute"),
        "hour": lambda: _spoken(whole("hour", 1, 12)),
        "minute": lambda: F.when(whole("minute", 0, 59) > 0, _spoken(whole("minute", 0, 59))).otherwise(""),
        "period": lambda: draws.choice("period", PERIODS),
        "time2": lambda: clock("hour2", "minute2"),
        "ic_number": lambda: _digits(
            F.concat(
                text(whole("ic_year", 60, 99)),
                two("ic_month", 1, 12),
                two("ic_day", 1, 28),
                two("ic_place", 1, 99),
                text(whole("ic_serial", 1000, 9999)),
            )
        ),
        "plate_number": lambda: F.concat(
            F.lit("W "),
            draws.choice("plate_letter", PLATE_LETTERS),
            F.lit(" "),
            _digits(whole("plate", 1000, 9999)),
        ),
    }
    for slot, (lead, low, high) in CODES.items():
        slots[slot] = lambda slot=slot, lead=lead, low=low, high=high: F.concat(
            F.lit(lead), _digits(draws.wide(slot, low, high))
        )
    return slots


def used_slots(templates: Sequence[str], draws: Draws) -> dict[str, Column]:
    """Only the number placeholders that some template names."""
    named = set(re.findall(PLACEHOLDER, "\n".join(templates)))
    return {slot: make() for slot, make in number_slots(draws).items() if slot in named}


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` placeholders; null when the template names an unknown one."""

    def value(name: Column) -> Column:
        out = F.lit(None).cast("string") if not values else None
        for known, column in values.items():
            out = F.when(name == known, column) if out is None else out.when(name == known, column)
        return out

    def body(text: Column) -> Column:
        gaps = F.split(text, PLACEHOLDER, -1)
        filled = F.transform(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1)), value)
        whole = F.array_join(
            F.zip_with(gaps, F.array_append(filled, F.lit("")), lambda g, v: F.concat(g, v)), ""
        )
        return F.when(~F.exists(filled, lambda v: v.isNull()), whole)

    return let(template, body)


def _template_table(templates: Sequence[str]) -> Column:
    return F.split(F.lit("\t".join(templates)), "\t")


def _with_samples(persons: DataFrame, first: int, samples: int, parts: int | None) -> DataFrame:
    """A row for every person and sample; ``parts`` deals them out, however few persons there are."""
    last = first + samples - 1
    if parts is None:
        return persons.withColumn("sample", F.explode(F.sequence(F.lit(first), F.lit(last))))
    starts = F.sequence(F.lit(first), F.lit(last), F.lit(SAMPLE_BLOCK))
    blocks = persons.withColumn("_from", F.explode(starts)).repartition(parts)
    end = F.least(F.col("_from") + (SAMPLE_BLOCK - 1), F.lit(last))
    return blocks.withColumn("sample", F.explode(F.sequence("_from", end))).drop("_from")


def generate_sentences(
    persons: DataFrame,
    templates: Sequence[str],
    per_person: int,
    kind: str = "mixed",
    min_length: int = 0,
    seed: int = 42,
    key: str = "name",
    first_round: int = 0,
    parts: int | None = None,
) -> DataFrame:
    """``per_person`` sentences for every person, template and numbers by seeded draws.

    ``kind`` is ``mixed`` (person and number placeholders) or ``name`` (person only). A sentence
    with an unknown placeholder or below the minimum length is dropped. ``parts`` is the number of
    tasks that make them; without it those that hold the persons do.
    """
    rows = _with_samples(persons, first_round, per_person, parts)
    draws = Draws(seed, F.concat_ws("|", F.col(key), F.col("sample").cast("string"), F.lit(kind)))
    pick = draws.between("template", 0, len(templates) - 1).cast("int")
    empty = F.lit("")
    field = lambda c: F.coalesce(F.col(c).cast("string"), empty) if c in persons.columns else empty
    values = {c: field(c) for c in ("name", "honorific", "position", "party")}
    values["position"] = F.coalesce(F.nullif(values["position"], empty), field("title"))
    if kind == "mixed":
        values |= used_slots(templates, draws)
    drawn = rows.withColumn("template", F.get(_template_table(templates), pick))
    text = speak_marked(fill_template(F.col("template"), values))
    filled = with_text(drawn, text, lambda t: F.length(t) >= min_length)
    return filled.select(
        "text",
        F.lit(kind).alias("type"),
        F.col("name").alias("person"),
        F.substring("template", 1, PREVIEW_CHARS).alias("template_preview"),
        "sample",
    )


def generate_number_sentences(
    rows: DataFrame, templates: Sequence[str], min_length: int = 0, seed: int = 42, key: str = "id"
) -> DataFrame:
    """One number-only sentence per input row; a template that asks for a person is dropped."""
    draws = Draws(seed, F.concat_ws("|", F.col(key).cast("string"), F.lit("number")))
    pick = draws.between("template", 0, len(templates) - 1).cast("int")
    text = speak_marked(fill_template(F.get(_template_table(templates), pick), used_slots(templates, draws)))
    filled = with_text(rows.select(key), text, lambda t: F.length(t) >= min_length)
    return filled.withColumn("type", F.lit("number"))


def unique_sentences(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """First sentence of every trimmed lower-case text."""
    return first_per_key(df, text_key(F.col("text")), order)


class TooFewSentences(ValueError):
    """The templates and persons give fewer different sentences than were asked for."""


def generate_until(
    make_round: Callable[[int, int], DataFrame],
    target: int,
    keys: int,
    existing: DataFrame | None = None,
    order: Sequence[str] = ("person", "sample"),
    save: Callable[[DataFrame], DataFrame] | None = None,
    seed: int = 42,
    per_key: int = 1,
    allow_short: bool = False,
) -> DataFrame:
    """Rounds of new sentences until ``target`` is reached, trimmed to it by a seeded sample.

    ``make_round`` gets the number of the first sample and the samples per key. A round is made for
    what is missing, at least ``per_key`` samples of each of the ``keys`` keys. Only a round that
    brings nothing new ends the work early; then ``TooFewSentences`` is raised unless
    ``allow_short``. ``save`` writes a round to the shared folder and reads it back, so that no round
    is made twice.
    """
    save = save or store
    kept: DataFrame | None = None
    total = first = 0
    while True:
        samples = max(per_key, -(-(target - total) // max(1, keys)))
        fresh = unique_sentences(make_round(first, samples), order)
        first += samples
        if existing is not None:
            fresh = not_yet_written(fresh, existing)
        if kept is not None:
            fresh = not_yet_written(fresh, kept)
        fresh = save(fresh)
        added = fresh.count()
        total += added
        kept = fresh if kept is None else kept.unionByName(fresh)
        if total >= target or not added:
            break
    if total < target and not allow_short:
        raise TooFewSentences(f"{total} of {target} sentences")
    if total <= target:
        return kept
    return seeded_sample(kept, target, ["text"], seed=seed, unique_key=True)


# ----------------------------------------------------------------------------------------------- quotas
def quota_plan(
    speakers: DataFrame,
    total: Column,
    languages: Sequence[tuple[str, float]],
    topics: Sequence[tuple[str, float]],
    sentence_types: Sequence[str],
    speaker: str = "speaker_id",
) -> DataFrame:
    """Rows per speaker, language, topic and sentence type.

    Language shares are cut to whole numbers and the last language gets the rest; topic shares
    likewise with the rest to the first topic; a topic is spread evenly over the sentence types,
    at least one each.
    """

    def shares(count: Column, weights: Sequence[tuple[str, float]], rest_to: int) -> Column:
        cut = [F.floor(count * F.lit(float(w))) for _, w in weights]
        others = [c for i, c in enumerate(cut) if i != rest_to % len(cut)]
        rest = count
        for c in others:
            rest = rest - c
        cut[rest_to % len(cut)] = rest
        return F.array(
            *[
                F.struct(F.lit(n).alias("name"), c.cast("bigint").alias("n"))
                for (n, _), c in zip(weights, cut)
            ]
        )

    by_language = speakers.select(
        speaker, F.inline(shares(total, languages, -1)).alias("language", "language_n")
    ).where("language_n > 0")
    by_topic = by_language.select(
        speaker,
        "language",
        "language_n",
        F.inline(shares(F.col("language_n"), topics, 0)).alias("topic", "topic_n"),
    ).where("topic_n > 0")
    per_type = F.greatest(F.lit(1), F.floor(F.col("topic_n") / len(sentence_types)))
    return by_topic.select(
        speaker,
        "language",
        "topic",
        F.explode(F.array(*[F.lit(t) for t in sentence_types])).alias("sentence_type"),
        per_type.cast("bigint").alias("n"),
    )


def sentences_by_share(
    speakers: DataFrame,
    total: int,
    shares: Sequence[tuple[str, float]],
    templates: dict[str, Sequence[str]],
    values: dict[str, dict[str, Sequence[str]]],
    speaker: str = "speaker_id",
    seed: int = 42,
) -> DataFrame:
    """Template sentences per speaker in fixed language shares (the last language gets the rest)."""
    counts = [int(total * w) for _, w in shares[:-1]]
    counts.append(total - sum(counts))
    plan = F.array(
        *[
            F.struct(F.lit(name).alias("language"), F.lit(n).alias("n"))
            for (name, _), n in zip(shares, counts)
            if n > 0
        ]
    )
    rows = speakers.select(speaker, F.inline(plan)).withColumn(
        "sample", F.explode(F.sequence(F.lit(1), F.col("n")))
    )
    draws = Draws(seed, F.concat_ws("|", F.col(speaker), F.col("language"), F.col("sample").cast("string")))
    text = None
    for language, options in templates.items():
        pick = draws.choice("template", options)
        slots = {s: draws.choice(s, v) for s, v in values.get(language, {}).items()}
        filled = fill_template(pick, slots) if slots else pick
        match = F.col("language") == language
        text = F.when(match, filled) if text is None else text.when(match, filled)
    return rows.select(
        text.alias("text"),
        "language",
        F.lit("general").alias("topic"),
        F.lit("statement").alias("sentence_type"),
        speaker,
        "sample",
    ).withColumn("word_count", F.size(words_of(F.col("text"))).cast("bigint"))
