"""Numbers, money, percentages, dates and times in words (Malay, English, Chinese).

Every speller works on a string of ASCII digits of any length, in groups taken from a
constant table, so that nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tuturan.functions.expr import SPACE, WORD, is_blank, let, replace_matches, squeeze, table_literal

# --- fixed values: digits and units ----------------------------------------------------------------
MALAY_DIGITS = ["kosong", "satu", "dua", "tiga", "empat", "lima", "enam", "tujuh", "lapan", "sembilan"]
MALAY_ORDINALS = [
    "pertama", "kedua", "ketiga", "keempat", "kelima",
    "keenam", "ketujuh", "kelapan", "kesembilan", "kesepuluh",
]
ENGLISH_SMALL = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine",
    "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen",
]
ENGLISH_TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
ENGLISH_SCALES = [
    "", "thousand", "million", "billion", "trillion", "quadrillion",
    "quintillion", "sextillion", "septillion", "octillion", "nonillion", "decillion",
]
CHINESE_DIGITS = "零一二三四五六七八九"
CHINESE_UNITS = ["", "十", "百", "千", "万", "十", "百", "千", "亿", "十", "百", "千", "万", "十", "百", "千"]

# --- fixed values: number patterns -----------------------------------------------------------------
RINGGIT = rf"RM{SPACE}*(\d{{1,3}}(?:,\d{{3}})*(?:\.\d{{2}})?|\d+(?:\.\d{{2}})?)"
YUAN = r"(\d+(?:\.\d{2})?)元"
PERCENT = rf"(\d+(?:\.\d+)?){SPACE}*%"
PLAIN = rf"(?=\d)(?<!{WORD})(\d{{1,3}}(?:,\d{{3}})*(?:\.\d+)?|\d+(?:\.\d+)?)(?!{WORD})"


def malay_table() -> list[str]:
    """Words for 0..999; zero is empty, as inside a longer number."""
    ones = ["", *MALAY_DIGITS[1:]]

    def below_hundred(n: int) -> str:
        if n in (10, 11):
            return ("sepuluh", "sebelas")[n - 10]
        tens, unit = divmod(n, 10)
        return {0: ones[unit], 1: f"{ones[unit]} belas"}.get(tens, f"{ones[tens]} puluh {ones[unit]}".strip())

    def below_thousand(n: int) -> str:
        hundreds, rest = divmod(n, 100)
        lead = {0: "", 1: "seratus"}.get(hundreds, f"{ones[hundreds]} ratus")
        return f"{lead} {below_hundred(rest)}".strip()

    return [below_thousand(n) for n in range(1000)]


def english_table() -> list[str]:
    """Words for 0..999; zero is empty, as inside a longer number."""

    def below_hundred(n: int) -> str:
        if n < 20:
            return ENGLISH_SMALL[n] if n else ""
        tens, unit = divmod(n, 10)
        return ENGLISH_TENS[tens - 2] + (f"-{ENGLISH_SMALL[unit]}" if unit else "")

    rows = []
    for n in range(1000):
        hundreds, rest = divmod(n, 100)
        parts = [f"{ENGLISH_SMALL[hundreds]} hundred"] * bool(hundreds) + [below_hundred(rest)] * bool(rest)
        rows.append(" and ".join(parts))
    return rows


def _groups(digits: Column, size: int) -> Column:
    """Digit string → integers of ``size`` digits each, most significant first."""
    whole = F.ceil(F.length(digits) / size) * size
    found = F.regexp_extract_all(F.lpad(digits, whole, "0"), F.lit(rf"\d{{{size}}}"), F.lit(0))
    return F.transform(found, lambda g: g.cast("int"))


def _digit_by_digit(digits: Column, names: Column, between: str) -> Column:
    spelled = F.transform(F.split(digits, ""), lambda d: F.get(names, d.cast("int")))
    return F.array_join(spelled, between)


def _canonical(digits: Column) -> Column:
    """Drop leading zeros, keep one digit."""
    return F.regexp_replace(digits, r"^0+(?=\d)", "")


def _join_words(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")


# ----------------------------------------------------------------------------------------------- Malay
def malay_digits_to_words(digits: Column) -> Column:
    """Cardinal words for a digit string of any length."""
    table = table_literal(malay_table())

    def below_billion(n: Column) -> Column:
        def scale(k: Column, single: str, unit: str) -> Column:
            many = F.concat(F.get(table, k), F.lit(unit))
            return F.when(k == 0, "").when(k == 1, F.lit(single)).otherwise(many)

        millions = (n / 1_000_000).cast("int")
        thousands = (n / 1000).cast("int") % 1000
        return _join_words(
            scale(millions, "sejuta", " juta"),
            scale(thousands, "seribu", " ribu"),
            F.get(table, n % 1000),
        )

    def step(done: Column, n: Column) -> Column:
        head = F.when(done != "", F.concat(done, F.lit(" bilion"))).otherwise("")
        return _join_words(head, below_billion(n))

    def below_million(n: Column) -> Column:
        rest = n % 1000
        head = F.when(n < 2000, "seribu").otherwise(F.concat(F.get(table, (n / 1000).cast("int")), F.lit(" ribu")))
        return F.concat(head, F.when(rest == 0, "").otherwise(F.concat(F.lit(" "), F.get(table, rest))))

    def spell(d: Column) -> Column:  # most numbers are one or two looks into the table, or one group
        size = F.length(d)
        return (
            F.when(size.between(1, 3), F.get(table, d.cast("int")))
            .when(size.between(4, 6) & ~F.startswith(d, F.lit("0")), let(d.cast("int"), below_million))
            .when(size.between(4, 9), let(d.cast("int"), below_billion))
            .otherwise(F.aggregate(_groups(_canonical(d), 9), F.lit(""), step))
        )

    spoken = let(digits, spell)
    return let(spoken, lambda s: F.when(s == "", MALAY_DIGITS[0]).otherwise(s))


def _signed(n: Column, minus: str, spell: Callable[[Column], Column]) -> Column:
    text = n.cast("string")
    return F.concat(
        F.when(text.startswith("-"), minus).otherwise(""), spell(F.regexp_replace(text, "^-", ""))
    )


def malay_words(n: Column) -> Column:
    """Cardinal words of an integer column."""
    return _signed(n, "negatif ", malay_digits_to_words)


def malay_spell_digits(text: Column) -> Column:
    """Digit by digit, everything else dropped (telephone and identity numbers)."""
    table = table_literal(MALAY_DIGITS)
    found = F.regexp_extract_all(text, F.lit(r"\d"), F.lit(0))
    return F.array_join(F.transform(found, lambda d: F.get(table, d.cast("int"))), " ")


def _money(
    amount: Column, spell: Callable[[Column], Column], major: str, gap: str, minor: str
) -> Column:
    """Whole part and rounded hundredths of a double column."""
    whole = F.floor(amount)
    cents = F.rint((amount - whole) * 100).cast("bigint")
    tail = F.when(cents > 0, F.concat(F.lit(gap), spell(cents), F.lit(minor))).otherwise("")
    return F.concat(spell(whole), F.lit(major), tail)


def malay_currency(amount: Column, use_rm: bool = False) -> Column:
    """Ringgit and sen; with ``use_rm`` the unit stands before the number."""
    if use_rm:
        return F.concat(F.lit("RM "), _money(amount, malay_words, "", " ringgit ", " sen"))
    return _money(amount, malay_words, " ringgit", " ", " sen")


def malay_percent(percent: Column) -> Column:
    """One decimal, cut off (not rounded) as a binary fraction."""
    whole = F.floor(percent)
    tenth = ((percent - whole) * 10).cast("bigint")
    return F.when(percent == whole, F.concat(malay_words(whole), F.lit(" peratus"))).otherwise(
        F.concat(malay_words(whole), F.lit(" perpuluhan "), malay_words(tenth), F.lit(" peratus"))
    )


def malay_year(year: Column) -> Column:
    """From 2000 on the thousands are always spoken as ``<n> ribu``."""
    rest = year % 1000
    late = F.concat(
        malay_words((year / 1000).cast("bigint")),
        F.lit(" ribu"),
        F.when(rest == 0, "").otherwise(F.concat(F.lit(" "), malay_words(rest))),
    )
    return F.when(year >= 2000, late).otherwise(malay_words(year))


def malay_date(day: Column, month_name: Column, year: Column) -> Column:
    return F.concat_ws(" ", malay_words(day), month_name, malay_year(year))


def malay_time(hour: Column, minute: Column | None = None) -> Column:
    spoken = F.concat(F.lit("pukul "), malay_words(hour))
    if minute is None:
        return spoken
    return F.concat(
        spoken, F.when(minute > 0, F.concat(F.lit(" "), malay_words(minute))).otherwise("")
    )


def malay_ordinal(n: Column) -> Column:
    table = table_literal(MALAY_ORDINALS)
    return F.when(n.between(1, 10), F.get(table, (n - 1).cast("int"))).otherwise(
        F.concat(F.lit("ke "), malay_words(n))
    )


# --------------------------------------------------------------------------------------------- English
def english_digits_to_words(digits: Column) -> Column:
    """Cardinal words up to decillions; a longer number is read digit by digit."""
    table = table_literal(english_table())
    names = F.split(F.lit(",".join(ENGLISH_SMALL[:10])), ",")
    scales = F.split(F.lit(",".join(ENGLISH_SCALES)), ",")

    def spell(d: Column) -> Column:
        groups = _groups(d, 3)
        last = F.size(groups) - 1

        def step(acc: Column, n: Column) -> Column:
            place = last - acc["seen"]
            words = F.when(place == 0, F.get(table, n)).otherwise(
                F.concat(F.get(table, n), F.lit(" "), F.get(scales, place))
            )
            joint = F.when(acc["text"] == "", "").when((place == 0) & (n < 100), " and ").otherwise(", ")
            text = F.when(n == 0, acc["text"]).otherwise(F.concat(acc["text"], joint, words))
            return F.struct((acc["seen"] + 1).alias("seen"), text.alias("text"))

        def thousands(n: Column) -> Column:
            rest = n % 1000
            joint = F.when(rest < 100, " and ").otherwise(", ")
            tail = F.when(rest == 0, "").otherwise(F.concat(joint, F.get(table, rest)))
            return F.concat(F.get(table, (n / 1000).cast("int")), F.lit(" thousand"), tail)

        start = F.struct(F.lit(0).alias("seen"), F.lit("").alias("text"))
        spoken = F.aggregate(groups, start, step, lambda acc: acc["text"])
        size = F.length(d)
        return (
            F.when(d == "0", ENGLISH_SMALL[0])
            .when(size.between(1, 3), F.get(table, d.cast("int")))
            .when(size.between(4, 6), let(d.cast("int"), thousands))
            .when(size > 3 * len(ENGLISH_SCALES), _digit_by_digit(d, names, " "))
            .otherwise(spoken)
        )

    return let(_canonical(digits), spell)


def english_words(n: Column) -> Column:
    return _signed(n, "minus ", english_digits_to_words)


def english_currency(amount: Column) -> Column:
    return _money(amount, english_words, " ringgit", " ", " sen")


# --------------------------------------------------------------------------------------------- Chinese
def chinese_digits_to_words(digits: Column) -> Column:
    """Cardinal characters up to sixteen digits; a longer number is read digit by digit."""
    names = F.split(F.lit(CHINESE_DIGITS), "")
    units = F.split(F.lit(",".join(CHINESE_UNITS)), ",")

    def spell(d: Column) -> Column:
        size = F.length(d)

        def one(i: Column) -> Column:
            digit = F.substr(d, i, F.lit(1)).cast("int")
            place = size - i
            name = F.get(names, digit)
            return F.when((digit == 0) & (place % 4 != 0), name).otherwise(
                F.concat(name, F.get(units, place))
            )

        raw = F.array_join(F.transform(F.sequence(F.lit(1), size), one), "")
        spoken = raw
        for pattern, to in [
            ("零+", "零"), ("零万", "万"), ("零亿", "亿"), ("亿万", "亿"), ("零+", "零"), ("^零+|零+$", ""), ("^一十", "十"),
        ]:
            spoken = F.regexp_replace(spoken, pattern, to)
        long = F.when(size > len(CHINESE_UNITS), _digit_by_digit(d, names, ""))
        return long.when(d == "0", "零").otherwise(spoken)

    return let(_canonical(digits), spell)


def chinese_words(n: Column) -> Column:
    return _signed(n, "负", chinese_digits_to_words)


def chinese_currency(amount: Column) -> Column:
    return _money(amount, chinese_words, "元", "", "分")


# ------------------------------------------------------------------------------------- numbers in text
CARDINALS = {
    "ms": malay_digits_to_words,
    "en": english_digits_to_words,
    "zh": chinese_digits_to_words,
}


def _whole(number: Column) -> Column:
    return F.substring_index(number, ".", 1)


def _fraction(number: Column) -> Column:
    return F.when(F.contains(number, F.lit(".")), F.substring_index(number, ".", -1)).otherwise("")


def _decimals(fraction: Column, language: str) -> Column:
    """Spoken decimals of a digit string, empty where nothing is spoken."""
    if language == "ms":
        return F.when(fraction == "", "").otherwise(
            F.concat(F.lit(" perpuluhan "), malay_spell_digits(fraction))
        )
    if language == "zh":
        return F.when(fraction == "", "").otherwise(
            F.concat(F.lit("点"), F.translate(fraction, "0123456789", CHINESE_DIGITS))
        )
    table = table_literal(ENGLISH_SMALL[:10])
    digits = F.regexp_extract_all(F.rtrim(fraction, F.lit("0")), F.lit(r"\d"), F.lit(0))
    spoken = F.array_join(F.transform(digits, lambda d: F.get(table, d.cast("int"))), " ")
    return F.when(fraction.rlike("[1-9]"), F.concat(F.lit(" point "), spoken)).otherwise("")


def spell_number(number: Column, language: str) -> Column:
    """A matched number, thousands commas and decimals included, in words."""
    return let(
        F.replace(number, F.lit(","), F.lit("")),
        lambda n: F.concat(CARDINALS[language](_whole(n)), _decimals(_fraction(n), language)),
    )


# Letters of an extinct script around a found amount or percentage: like the words that will
# stand there, they leave no word edge to a neighbouring digit.
_OPEN, _CLOSE = "\U00010000", "\U00010001"
_FOUND = rf"{_OPEN}[MP][\d.,]+{_CLOSE}|{PLAIN}"


def _spell_found(found: Column, language: str) -> Column:
    """An amount, a percentage or a plain number, told apart by its mark."""
    hundreds = table_literal(malay_table() if language == "ms" else english_table())
    unit = " peratus" if language == "ms" else " percent"

    def body(p: Column) -> Column:
        kind, fraction = p["kind"], p["fraction"]
        some = fraction.rlike("[1-9]")
        sen = F.when(
            some, F.concat(F.lit(" "), F.get(hundreds, fraction.try_cast("int")), F.lit(" sen"))
        ).otherwise("")
        tail = (
            F.when(kind == "M", F.concat(F.lit(" ringgit"), sen))
            .when((kind == "P") & ~some, F.lit(unit))
            .when(kind == "P", F.concat(_decimals(fraction, language), F.lit(unit)))
            .otherwise(_decimals(fraction, language))
        )
        return F.concat(CARDINALS[language](p["whole"]), tail)

    marked = F.startswith(found, F.lit(_OPEN))
    inside = F.when(marked, F.substring(found, F.lit(3), F.length(found) - 3)).otherwise(found)
    parts = lambda number: F.struct(
        F.substring(found, 2, 1).alias("kind"),
        _whole(number).alias("whole"),
        _fraction(number).alias("fraction"),
    )
    return let(let(F.replace(inside, F.lit(","), F.lit("")), parts), body)


def _normalize_chinese(text: Column) -> Column:
    def money(found: Column) -> Column:
        amount = F.replace(found, F.lit("元"), F.lit(""))
        cents = _fraction(amount)
        tail = F.when(
            cents.rlike("[1-9]"), F.concat(chinese_digits_to_words(cents), F.lit("分"))
        ).otherwise("")
        return F.concat(chinese_digits_to_words(_whole(amount)), F.lit("元"), tail)

    def percent(found: Column) -> Column:
        number = F.regexp_replace(found, r"[^\d.]", "")
        return F.when(_fraction(number).rlike("[1-9]"), found).otherwise(
            F.concat(F.lit("百分之"), chinese_digits_to_words(_whole(number)))
        )

    text = replace_matches(replace_matches(text, YUAN, money), PERCENT, percent)
    return replace_matches(text, PLAIN, lambda m: spell_number(m, "zh"))


def normalize_numbers(col: Column, language: str, tidy: bool = True) -> Column:
    """Money, then percentages, then the remaining numbers, each in words.

    A language other than ``ms``, ``en`` and ``zh`` has no money rule and uses English words.
    ``tidy=False`` leaves the white space to a later step.
    """

    def body(raw: Column) -> Column:
        if language == "zh":
            return _normalize_chinese(raw)
        text = squeeze(raw) if tidy else raw  # it is shorter now; words of numbers need no tidying
        if language in CARDINALS:
            text = F.regexp_replace(text, RINGGIT, f"{_OPEN}M$1{_CLOSE}")
        text = F.regexp_replace(text, PERCENT, f"{_OPEN}P$1{_CLOSE}")
        speller = language if language in CARDINALS else "en"
        return replace_matches(text, _FOUND, lambda m: _spell_found(m, speller))

    if not tidy:
        return let(col, lambda t: F.when(t.rlike(r"\d"), body(t)).otherwise(t))
    return let(
        col,
        lambda t: F.when(t.rlike(r"\d"), squeeze(body(t)) if language == "zh" else body(t))
        .when(is_blank(t), t)
        .otherwise(squeeze(t)),
    )
