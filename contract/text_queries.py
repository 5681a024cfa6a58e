"""Text functions over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.base import (
    TAGGED,
    query,
    sql_fold,
    sql_quote,
    sql_squeeze,
    table,
    tagged,
    sql_strip,
    sql_words,
    sql_decoded,
    sql_encoded,
)
from tuturan.functions.expr import EDGE
from tuturan.functions import arrow, asr, language as L, numbers as N, repetition, scoring as S, text as X
from tuturan.operators.filters import stem
from tuturan.sources.readers import parse_spec



def docs(spark, d, *cols):
    return table(spark, d, "documents").select("doc_id", *cols)


@query(
    "txt1_strip_markers",
    f"WITH {TAGGED} SELECT doc_id, text FROM parsed",
)
def txt1(spark, d):
    return tagged(spark, d).select("doc_id", X.strip_markers(F.col("segment_timestamp")).alias("text"))


@query("txt2_marker_language", f"WITH {TAGGED} SELECT doc_id, language FROM parsed")
def txt2(spark, d):
    return tagged(spark, d).select(
        "doc_id", X.marker_language(F.col("segment_timestamp")).alias("language")
    )


@query("txt3_marker_duration", f"WITH {TAGGED} SELECT doc_id, duration FROM parsed")
def txt3(spark, d):
    return tagged(spark, d).select(
        "doc_id", X.marker_duration(F.col("segment_timestamp")).alias("duration")
    )


# Letters stand in for typographic characters, which the tables do not hold.
TYPO_FROM = "bdfghkpvwxz"
TYPO_TO = "“’— …​`‑ ﻿„"
TYPO_PLAIN = {"b": '"', "d": "'", "f": "-", "g": " ", "h": "...", "k": "", "p": "'", "v": "-", "w": " ", "x": "", "z": '"'}


def _typo_sql() -> str:
    out = "text"
    for letter, plain in TYPO_PLAIN.items():
        out = f"replace({out}, '{letter}', {sql_quote(plain)})"
    return out


@query("txt4_normalize_characters", f"SELECT doc_id, {_typo_sql()} AS text FROM documents")
def txt4(spark, d):
    written = F.translate(F.col("text"), TYPO_FROM, TYPO_TO)
    return docs(spark, d, X.normalize_characters(written).alias("text"))


EMOJI_FROM = "bdfgkpvwxz"
EMOJI_TO = "\U0001F600\U0001F300\U0001F680\U0001F9FF\U0001FA70✂☀⭐⌚️"


@query(
    "txt5_remove_emoji",
    f"SELECT doc_id, translate(text, '{EMOJI_FROM}', '') AS text FROM documents",
)
def txt5(spark, d):
    return docs(spark, d, X.remove_emoji(F.translate(F.col("text"), EMOJI_FROM, EMOJI_TO)).alias("text"))


for _code in ("en", "ms"):

    @query(
        f"txt6_expand_abbreviations_{_code}",
        f"SELECT doc_id, {sql_decoded(sql_fold(sql_encoded('text'), X.ABBREVIATIONS[_code]))} AS text FROM documents",
    )
    def txt6(spark, d, code=_code):
        return docs(spark, d, X.expand_abbreviations(F.col("text"), code).alias("text"))


@query(
    "txt7_normalize_particles",
    f"SELECT doc_id, {sql_decoded(sql_fold(sql_encoded('text'), X.PARTICLES))} AS text FROM documents",
)
def txt7(spark, d):
    return docs(spark, d, X.normalize_particles(F.col("text")).alias("text"))


# ----------------------------------------------------------------------------------------------- numbers
MS_WORDS = f"string_split({sql_quote(chr(9).join(N.malay_table()))}, chr(9))"
EN_WORDS = f"string_split({sql_quote(chr(9).join(N.english_table()))}, chr(9))"
WORDS = f"w AS (SELECT {MS_WORDS} AS ms, {EN_WORDS} AS en)"


def sql_ms(n: str) -> str:
    """Malay words of a BIGINT expression below a billion (the list ``ms`` in scope)."""
    n = f"CAST({n} AS BIGINT)"

    def scale(k: str, single: str, unit: str) -> str:
        return f"CASE WHEN {k} = 0 THEN NULL WHEN {k} = 1 THEN '{single}' ELSE ms[{k} + 1] || ' {unit}' END"

    return (
        f"CASE WHEN {n} = 0 THEN 'kosong' ELSE concat_ws(' ', "
        f"{scale(f'({n} // 1000000)', 'sejuta', 'juta')}, "
        f"{scale(f'({n} // 1000 % 1000)', 'seribu', 'ribu')}, "
        f"nullif(ms[{n} % 1000 + 1], '')) END"
    )


def sql_en(n: str) -> str:
    """English words of a BIGINT expression below a billion (the list ``en`` in scope)."""
    n = f"CAST({n} AS BIGINT)"
    million, thousand, rest = f"({n} // 1000000)", f"({n} // 1000 % 1000)", f"({n} % 1000)"
    high = (
        f"concat_ws(', ', CASE WHEN {million} > 0 THEN en[{million} + 1] || ' million' END, "
        f"CASE WHEN {thousand} > 0 THEN en[{thousand} + 1] || ' thousand' END)"
    )
    return (
        f"CASE WHEN {n} = 0 THEN 'zero' WHEN {rest} = 0 THEN {high} "
        f"WHEN {n} < 1000 THEN en[{rest} + 1] "
        f"WHEN {rest} < 100 THEN {high} || ' and ' || en[{rest} + 1] "
        f"ELSE {high} || ', ' || en[{rest} + 1] END"
    )


def sql_spell_ms(text: str) -> str:
    digits = "['kosong','satu','dua','tiga','empat','lima','enam','tujuh','lapan','sembilan']"
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, '[0-9]'), "
        f"lambda c: {digits}[CAST(c AS INTEGER) + 1]), ' ')"
    )


@query(
    "txt8_malay_words",
    f"WITH {WORDS} SELECT o_orderkey, {sql_ms('o_orderkey * 7919 % 1000000000')} AS large, "
    f"{sql_ms('o_custkey')} AS customer, 'negatif ' || {sql_ms('o_orderkey + 1')} AS negative "
    "FROM orders, w",
)
def txt8(spark, d):
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey",
        N.malay_words(key * 7919 % 1_000_000_000).alias("large"),
        N.malay_words(F.col("o_custkey")).alias("customer"),
        N.malay_words(-(key + 1)).alias("negative"),
    )


CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
MONTH_LIST = "['Januari','Februari','Mac','April','Mei','Jun','Julai','Ogos','September','Oktober','November','Disember']"


@query(
    "txt9_malay_phrases",
    f"""WITH {WORDS}, o AS (
  SELECT *, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(month(o_orderdate) AS BIGINT) AS m,
         CAST(year(o_orderdate) AS BIGINT) AS y, {CENTS} AS cents FROM orders)
SELECT o_orderkey,
  {sql_ms('cents // 100')} || ' ringgit'
    || CASE WHEN cents % 100 > 0 THEN ' ' || {sql_ms('cents % 100')} || ' sen' ELSE '' END AS money,
  'RM ' || {sql_ms('cents // 100')}
    || CASE WHEN cents % 100 > 0 THEN ' ringgit ' || {sql_ms('cents % 100')} || ' sen' ELSE '' END
    AS money_rm,
  {sql_ms('d')} || ' ' || {MONTH_LIST}[m] || ' ' || CASE WHEN y >= 2000
    THEN {sql_ms('y // 1000')} || ' ribu'
         || CASE WHEN y % 1000 = 0 THEN '' ELSE ' ' || {sql_ms('y % 1000')} END
    ELSE {sql_ms('y')} END AS spoken_date,
  'pukul ' || {sql_ms('m')} || CASE WHEN o_orderkey % 60 > 0 THEN ' ' || {sql_ms('o_orderkey % 60')} ELSE '' END
    AS spoken_time,
  {sql_spell_ms("'01' || CAST(o_orderkey AS VARCHAR) || '-' || CAST(o_custkey AS VARCHAR)")} AS phone,
  CASE WHEN d <= 10 THEN ['pertama','kedua','ketiga','keempat','kelima','keenam','ketujuh','kelapan','kesembilan','kesepuluh'][d]
    ELSE 'ke ' || {sql_ms('d')} END AS ordinal,
  CASE WHEN o_orderkey % 10 = 0 THEN {sql_ms('o_orderkey // 10')} || ' peratus'
    ELSE {sql_ms('o_orderkey // 10')} || ' perpuluhan '
      || {sql_ms('CAST(floor((o_orderkey / CAST(10 AS DOUBLE) - floor(o_orderkey / CAST(10 AS DOUBLE))) * 10) AS BIGINT)')}
      || ' peratus' END AS percent
FROM o, w""",
)
def txt9(spark, d):
    day, month, year = (f(F.col("o_orderdate")) for f in (F.dayofmonth, F.month, F.year))
    names = F.split(F.lit("Januari Februari Mac April Mei Jun Julai Ogos September Oktober November Disember"), " ")
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey",
        N.malay_currency(F.col("o_totalprice")).alias("money"),
        N.malay_currency(F.col("o_totalprice"), use_rm=True).alias("money_rm"),
        N.malay_date(day, F.get(names, month - 1), year).alias("spoken_date"),
        N.malay_time(month, key % 60).alias("spoken_time"),
        N.malay_spell_digits(
            F.concat(F.lit("01"), key.cast("string"), F.lit("-"), F.col("o_custkey").cast("string"))
        ).alias("phone"),
        N.malay_ordinal(day).alias("ordinal"),
        N.malay_percent(key / 10).alias("percent"),
    )


@query(
    "txt10_english_words",
    f"""WITH {WORDS}, o AS (SELECT *, {CENTS} AS cents FROM orders)
SELECT o_orderkey, {sql_en('o_orderkey * 7919 % 1000000000')} AS large, {sql_en('o_custkey')} AS customer,
  {sql_en('cents // 100')} || ' ringgit'
    || CASE WHEN cents % 100 > 0 THEN ' ' || {sql_en('cents % 100')} || ' sen' ELSE '' END AS money
FROM o, w""",
)
def txt10(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey",
        N.english_words(F.col("o_orderkey") * 7919 % 1_000_000_000).alias("large"),
        N.english_words(F.col("o_custkey")).alias("customer"),
        N.english_currency(F.col("o_totalprice")).alias("money"),
    )


def sql_zh(n: str) -> str:
    """Chinese words of a BIGINT expression below a hundred million, from two four-digit halves."""
    digit = "['零','一','二','三','四','五','六','七','八','九']"

    def four(x: str) -> str:
        parts = []
        for power, unit in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
            k = f"({x} // {power} % 10)"
            parts.append(f"CASE WHEN {k} = 0 THEN '零' ELSE {digit}[{k} + 1] || '{unit}' END")
        raw = " || ".join(parts)
        return f"regexp_replace({raw}, '零+', '零', 'g')"

    n = f"CAST({n} AS BIGINT)"
    high, low = f"({n} // 10000)", f"({n} % 10000)"
    cut_high = f"regexp_replace(regexp_replace({four(high)}, '零$', ''), '^零', '')"
    raw = (
        f"CASE WHEN {high} > 0 THEN {cut_high} || '万' ELSE '' END || "
        f"CASE WHEN {low} > 0 THEN regexp_replace({four(low)}, '零$', '') ELSE '' END"
    )
    return (
        f"CASE WHEN {n} = 0 THEN '零' ELSE "
        f"regexp_replace(regexp_replace({raw}, '^零', ''), '^一十', '十') END"
    )


@query(
    "txt11_chinese_words",
    f"""WITH o AS (SELECT *, {CENTS} AS cents FROM orders)
SELECT o_orderkey, {sql_zh('o_orderkey * 7919 % 100000000')} AS large, {sql_zh('o_custkey')} AS customer,
  {sql_zh('cents // 100')} || '元'
    || CASE WHEN cents % 100 > 0 THEN {sql_zh('cents % 100')} || '分' ELSE '' END AS money
FROM o""",
)
def txt11(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey",
        N.chinese_words(F.col("o_orderkey") * 7919 % 100_000_000).alias("large"),
        N.chinese_words(F.col("o_custkey")).alias("customer"),
        N.chinese_currency(F.col("o_totalprice")).alias("money"),
    )


def _number_sql(words, point: str, percent: str, digit_word) -> str:
    tenths = "(o_orderkey % 300)"
    return (
        f"'bayar ' || {words('cents // 100')} || ' ringgit' || CASE WHEN cents % 100 > 0 THEN ' ' || "
        f"{words('cents % 100')} || ' sen' ELSE '' END || ' untuk ' || {words('o_custkey')} || ' unit, ' || "
        f"CASE WHEN {tenths} % 10 = 0 THEN {words(tenths + ' // 10')} ELSE {words(tenths + ' // 10')} || "
        f"' {point} ' || {digit_word(tenths + ' % 10')} END || ' {percent} dan x9y'"
    )


@query(
    "txt12_normalize_numbers",
    f"""WITH {WORDS}, o AS (SELECT *, {CENTS} AS cents FROM orders)
SELECT o_orderkey, {_number_sql(sql_ms, 'perpuluhan', 'peratus', sql_ms)} AS ms,
  {_number_sql(sql_en, 'point', 'percent', sql_en)} AS en FROM o, w""",
)
def txt12(spark, d):
    """Money with thousands commas, a count with commas, a percentage with one decimal."""
    tenths = F.col("o_orderkey") % 300
    written = F.concat(
        F.lit("bayar RM "),
        F.format_number("o_totalprice", 2),
        F.lit(" untuk "),
        F.format_number("o_custkey", 0),
        F.lit("  unit, "),
        F.format_string("%.1f", tenths / 10),
        F.lit(" % dan x9y"),
    )
    orders = table(spark, d, "orders").select("o_orderkey", written.alias("written"))
    return orders.select(
        "o_orderkey",
        N.normalize_numbers(F.col("written"), "ms").alias("ms"),
        N.normalize_numbers(F.col("written"), "en").alias("en"),
    )


SQL_CLEAN = "regexp_replace({0}, '[^a-zA-Z0-9\\s''\\-@À-ÖØ-öø-ÿĀ-ſ]', '', 'g')"


def sql_ms_long(n: str) -> str:
    """Malay words of a BIGINT expression of up to eighteen digits."""
    n = f"CAST({n} AS BIGINT)"
    high, low = f"({n} // 1000000000)", f"({n} % 1000000000)"
    low_words = f"CASE WHEN {low} > 0 THEN {sql_ms(low)} END"
    return f"CASE WHEN {high} = 0 THEN {sql_ms(n)} ELSE concat_ws(' ', {sql_ms(high)} || ' bilion', {low_words}) END"


def sql_en_long(n: str) -> str:
    """English words of a BIGINT expression of up to eighteen digits."""
    n = f"CAST({n} AS BIGINT)"
    parts = []
    for power, unit in ((15, "quadrillion"), (12, "trillion"), (9, "billion"), (6, "million"), (3, "thousand")):
        k = f"({n} // {10**power} % 1000)"
        parts.append(f"CASE WHEN {k} > 0 THEN en[{k} + 1] || ' {unit}' END")
    high, rest = f"concat_ws(', ', {', '.join(parts)})", f"({n} % 1000)"
    return (
        f"CASE WHEN {n} = 0 THEN 'zero' WHEN {rest} = 0 THEN {high} WHEN {n} < 1000 THEN en[{rest} + 1] "
        f"WHEN {rest} < 100 THEN {high} || ' and ' || en[{rest} + 1] ELSE {high} || ', ' || en[{rest} + 1] END"
    )


def sql_spell_en(text: str) -> str:
    digits = "['zero','one','two','three','four','five','six','seven','eight','nine']"
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, '[0-9]'), "
        f"lambda c: {digits}[CAST(c AS INTEGER) + 1]), ' ')"
    )


def sql_spoken(found: str, code: str, percent: bool) -> str:
    """A found number or percentage in words (the lists ``ms`` and ``en`` in scope)."""
    number = f"regexp_replace({found}, '[^0-9.]', '', 'g')"
    whole, fraction = f"split_part({number}, '.', 1)", f"split_part({number}, '.', 2)"
    some = f"regexp_matches({fraction}, '[1-9]')"
    if code == "ms":
        said = f"' perpuluhan ' || {sql_spell_ms(fraction)}"
        said = f"CASE WHEN {some if percent else f"{fraction} <> ''"} THEN {said} ELSE '' END"
        return f"{sql_ms_long(whole)} || {said}" + (" || ' peratus'" if percent else "")
    said = f"' point ' || {sql_spell_en(f'rtrim({fraction}, chr(48))')}"
    said = f"CASE WHEN {some} THEN {said} ELSE '' END"
    return f"{sql_en_long(whole)} || {said}" + (" || ' percent'" if percent else "")


SQL_PERCENT = "[0-9]+(?:\\.[0-9]+)?\\s*%"
SQL_PLAIN_NUMBER = "\\b(?:[0-9]{1,3}(?:,[0-9]{3})*(?:\\.[0-9]+)?|[0-9]+(?:\\.[0-9]+)?)\\b"


def sql_numbers(name: str, source: str, text: str, pattern: str, percent: bool) -> str:
    """CTE ``name``: ``source`` with ``text`` cut at the matches and joined with the spoken ones."""
    spoken = (
        f"CASE WHEN code = 'ms' THEN {sql_spoken('found[i]', 'ms', percent)} "
        f"ELSE {sql_spoken('found[i]', 'en', percent)} END"
    )
    return f"""{name}_cut AS (SELECT *, string_split_regex({text}, '{pattern}') AS gaps, regexp_extract_all({text}, '{pattern}') AS found FROM {source}),
{name} AS (SELECT {name}_cut.* EXCLUDE (gaps, found) REPLACE (array_to_string(list_transform(gaps,
  lambda gap, i: gap || CASE WHEN found[i] IS NULL THEN '' ELSE {spoken} END), '') AS {text}) FROM {name}_cut, w)"""


def sql_prepared_rows(source: str, code: str, clean: bool) -> str:
    """CTE ``ready``: rows of ``source`` with the whole preparation of their text, as it is."""
    done = sql_decoded("lower(t)")
    text = f"CASE code WHEN 'ms' THEN {sql_fold('t', X.ABBREVIATIONS['ms'])} ELSE {sql_fold('t', X.ABBREVIATIONS['en'])} END"
    return f"""{WORDS}, coded AS (SELECT *, {code} AS code, {sql_encoded('text')} AS t FROM {source}),
spelt AS (SELECT * REPLACE ({text} AS t) FROM coded),
{sql_numbers('shares', 'spelt', 't', SQL_PERCENT, True)},
{sql_numbers('numbered', 'shares', 't', SQL_PLAIN_NUMBER, False)},
talked AS (SELECT * REPLACE ({sql_fold(sql_squeeze('t'), X.PARTICLES)} AS t) FROM numbered),
ready AS (SELECT * EXCLUDE (t, code) REPLACE ({sql_squeeze(SQL_CLEAN.format(done) if clean else done)} AS text) FROM talked)"""


@query(
    "txt12_document_numbers_ms",
    f"""WITH {WORDS}, coded AS (SELECT doc_id, 'ms' AS code, {sql_encoded('text')} AS t FROM documents),
{sql_numbers('shares', 'coded', 't', SQL_PERCENT, True)},
{sql_numbers('numbered', 'shares', 't', SQL_PLAIN_NUMBER, False)}
SELECT doc_id, {sql_squeeze(sql_decoded('t'))} AS text FROM numbered""",
)
def txt12_documents(spark, d):
    return docs(spark, d, N.normalize_numbers(F.col("text"), "ms").alias("text"))


# ----------------------------------------------------------------------------------------------- Chinese
# Letters become Chinese characters, full-width forms and punctuation.
ZH_FROM = "aeiounrstlhdcmpgbf.,!?'x0123456789"
ZH_TO = "我你他的是不了在有人这中大来上国和地。，！？「ｘ０１２３４５６７８９"


def zh_text(col):
    return F.translate(col, ZH_FROM, ZH_TO)


SQL_ZH_TEXT = f"translate(text, {sql_quote(ZH_FROM)}, {sql_quote(ZH_TO)})"
WIDE_FROM = "abcABC0123456789.,! "
WIDE_TO = "ａｂｃＡＢＣ０１２３４５６７８９．，！　"


@query("txt13_fullwidth_to_halfwidth", "SELECT doc_id, text FROM documents")
def txt13(spark, d):
    return docs(spark, d, X.fullwidth_to_halfwidth(F.translate(F.col("text"), WIDE_FROM, WIDE_TO)).alias("text"))


@query(
    "txt14_noise_and_punctuation",
    f"SELECT doc_id, translate({SQL_ZH_TEXT}, '。，！？「\"', '') AS text, "
    "replace(text, ' ', '') AS denoised FROM documents WHERE true",
)
def txt14(spark, d):
    noisy = F.regexp_replace(F.col("text"), " ", "[Noise]<unk>")
    return docs(
        spark,
        d,
        X.remove_chinese_punctuation(zh_text(F.col("text"))).alias("text"),
        X.remove_noise_markers(noisy).alias("denoised"),
    )


SQL_ZH_DONE = (
    "trim(regexp_replace(regexp_replace(translate("
    + SQL_ZH_TEXT
    + ", 'ｘ０１２３４５６７８９。，！？「', 'x0123456789'), '[^\\pL\\pN_\\s'']', '', 'g'), '\\s+', ' ', 'g'))"
)


@query("txt15_preprocess_zh", f"SELECT doc_id, {SQL_ZH_DONE} AS text FROM documents")
def txt15(spark, d):
    return docs(spark, d, X.preprocess_zh(zh_text(F.col("text"))).alias("text"))




@query("txt16_clean_for_asr", f"SELECT doc_id, {sql_squeeze(SQL_CLEAN.format('text'))} AS text FROM documents")
def txt16(spark, d):
    return docs(spark, d, X.clean_for_asr(F.col("text")).alias("text"))


BY_LANG = "CASE WHEN lang IN ('es', 'de') THEN 'ms' ELSE 'en' END"


@query(
    "txt17_preprocess_asr",
    f"WITH {sql_prepared_rows('documents', BY_LANG, False)} SELECT doc_id, text FROM ready",
)
def txt17(spark, d):
    """The texts as they are; es and de stand in for Malay, the others take the English route."""
    lang = F.when(F.col("lang").isin("es", "de"), "ms").otherwise("en")
    return docs(spark, d, asr.preprocess_asr(F.col("text"), lang).alias("text"))


@query(
    "txt17_preprocess_asr_documents",
    f"""WITH {sql_prepared_rows('documents', "'en'", True)} SELECT doc_id, text FROM ready""",
)
def txt17_documents(spark, d):
    """The texts as they are in their own languages, cleaned for recognition."""
    return docs(
        spark, d, asr.preprocess_asr(F.col("text"), L.spoken_language(F.col("lang")), clean_for_asr=True).alias("text")
    )


@query(
    "txt18_script_detection",
    "SELECT doc_id, doc_id % 3 = 0 AS chinese, doc_id % 3 = 1 AS cyrillic, doc_id % 3 <> 2 AS non_latin "
    "FROM documents WHERE true",
)
def txt18(spark, d):
    """A character of another script is put at the end of two of three documents."""
    end = F.when(F.col("doc_id") % 3 == 0, "好").when(F.col("doc_id") % 3 == 1, "ж").otherwise("é")
    marked = docs(spark, d, F.concat(F.col("text"), end).alias("text"))
    return marked.select(
        "doc_id",
        X.contains_script(F.col("text"), "chinese").alias("chinese"),
        X.contains_script(F.col("text"), "cyrillic").alias("cyrillic"),
        X.contains_non_latin(F.col("text")).alias("non_latin"),
    )


def sql_scoring_ms(text: str) -> str:
    out = f"lower({text})"
    ignored = "[/:\\\\;\"−*`‑―''„~«»–—…\\[\\]()\\t\\r\\n!?,.]"
    out = f"regexp_replace({out}, '{ignored}', ' ', 'g')"
    edge = "(^|[^\\pL\\pN_])-+($|[^\\pL\\pN_])"
    for _ in range(2):
        out = f"regexp_replace({out}, '{edge}', '\\1 \\2', 'g')"
    out = f"regexp_replace({out}, '[^\\pL\\pN_\\s\\-]', ' ', 'g')"
    out = f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"
    return f"regexp_replace({out}, '\\s\\s+', ' ', 'g')"


@query("txt19_scoring_text_ms", f"SELECT doc_id, {sql_scoring_ms('text')} AS text FROM documents")
def txt19(spark, d):
    return docs(spark, d, S.scoring_text_ms(F.col("text")).alias("text"))


SQL_SCORING_ZH = (
    "lower(array_to_string(string_split(regexp_replace("
    + SQL_ZH_TEXT
    + ", '[，。！？、：；\"（）【】《》\\s]+', '', 'g'), ''), ' '))"
)


@query("txt21_scoring_text_zh", f"SELECT doc_id, {SQL_SCORING_ZH} AS text FROM documents")
def txt21(spark, d):
    return docs(spark, d, S.scoring_text_zh(zh_text(F.col("text"))).alias("text"))


def sql_compounds(text: str) -> str:
    out = f"lower({text})"
    for spaced, joined in S.COMPOUND_WORDS:
        out = f"replace({out}, '{spaced}', '{joined}')"
    return out


COMPOUND_START = "may bank i c pin kod e-wallet "


@query(
    "txt22_fold_compounds",
    f"SELECT doc_id, {sql_compounds(chr(39) + COMPOUND_START + chr(39) + ' || replace(text, chr(10), chr(32))')} AS text FROM documents",
)
def txt22(spark, d):
    return docs(
        spark, d, S.fold_compounds(F.concat(F.lit(COMPOUND_START), F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))).alias("text")
    )


# Frequent short words of the tables stand in for the Malay keywords.
STAND_IN = ["der", "die", "que", "los", "les", "und", "el", "des"]
SQL_HITS = (
    "len(list_intersect(list_distinct(string_split_regex(lower(text), '\\s+')), "
    + "[" + ", ".join(f"'{w}'" for w in STAND_IN) + "]))"
)
MIXED = "CASE WHEN doc_id % 5 = 0 THEN translate(text, 'aeioun', '我你他的是不') ELSE text END"
SQL_CHINESE = "len(regexp_extract_all(text, '[一-鿿㐀-䶿]'))"


@query(
    "txt23_detect_language",
    f"WITH t AS (SELECT doc_id, {MIXED} AS text FROM documents) SELECT doc_id, "
    f"CASE WHEN {SQL_CHINESE} / CAST(greatest(length(replace(text, ' ', '')), 1) AS DOUBLE) > 0.3 THEN 'zh' "
    f"WHEN {SQL_HITS} >= 2 THEN 'ms' ELSE 'en' END AS language FROM t",
)
def txt23(spark, d):
    mixed = F.when(F.col("doc_id") % 5 == 0, F.translate(F.col("text"), "aeioun", "我你他的是不")).otherwise(F.col("text"))
    return docs(spark, d, mixed.alias("text")).select(
        "doc_id", L.detect_language(F.col("text"), STAND_IN).alias("language")
    )


@query(
    "txt24_tag_text",
    "SELECT doc_id, CASE WHEN lang = 'fr' THEN '<|ja|>' WHEN lang = 'de' THEN '<|ms|>' ELSE '<|en|>' END "
    "|| ' ' || text AS text FROM documents",
)
def txt24(spark, d):
    code = F.when(F.col("lang") == "fr", "ja").when(F.col("lang") == "de", "ms").otherwise(F.col("lang"))
    return docs(spark, d, L.tag_text(F.col("text"), code).alias("text"))


SPEECH_MAP = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in X.SPEECH_ABBREVIATIONS.items()) + "}"


@query(
    "txt25_speech_abbreviations",
    f"""WITH t AS (SELECT doc_id, regexp_replace({sql_encoded('text')}, '\\b(de|an|of|el)\\b', 'Yg', 'g') AS text FROM documents),
m AS (SELECT {SPEECH_MAP} AS short)
SELECT doc_id, {sql_decoded("""array_to_string(list_transform(string_split({sql_squeeze('text')}, ' '),
  lambda w: coalesce(short[regexp_replace(lower(w), '[^\\pL\\pN_]', '', 'g')]
                     || regexp_extract(w, '[^\\pL\\pN_]+$'), w)), ' ')""".replace("{sql_squeeze('text')}", sql_squeeze('text')))} AS text FROM t, m""",
)
def txt25(spark, d):
    written = F.regexp_replace("text", f"{EDGE}(de|an|of|el){EDGE}", "Yg")
    return docs(spark, d, X.expand_speech_abbreviations(written).alias("text"))


LATIN_TOKENS = f"regexp_extract_all(text, '[A-Za-z'']+|[^\\pL\\pN_\\s]+|\\s+')"


@query(
    "txt26_language_runs",
    f"""WITH t AS (SELECT doc_id, unnest({LATIN_TOKENS}) AS token, generate_subscripts({LATIN_TOKENS}, 1) AS pos FROM documents),
k AS (SELECT *, CASE WHEN regexp_matches(token, '^[A-Za-z'']') THEN CASE WHEN lower(token) IN ('the', 'and', 'der', 'que') THEN 'en' ELSE 'ms' END
    WHEN NOT regexp_matches(token, '^\\s') THEN 'mark' END AS kind FROM t),
s AS (SELECT *, CASE WHEN kind = 'mark' AND row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1 THEN 'ms' ELSE kind END AS language FROM k WHERE kind IS NOT NULL),
c AS (SELECT *, CASE WHEN language = lag(language) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM s WHERE language <> 'mark'),
r AS (SELECT k.doc_id, k.pos, k.token, c.language, greatest(sum(coalesce(c.fresh, 0)) OVER (PARTITION BY k.doc_id ORDER BY k.pos), 1) - 1 AS run
  FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.pos = c.pos)
SELECT doc_id, CAST(run AS INTEGER) AS run, max(language) AS language, trim(string_agg(token, '' ORDER BY pos), ' \n') AS text FROM r GROUP BY doc_id, run""",
)
def txt26(spark, d):
    """Runs of one language; frequent words of the tables stand in for the English list."""
    runs = docs(spark, d, F.posexplode(L.language_runs(F.col("text"), ["the", "and", "der", "que"])).alias("run", "part"))
    return runs.select("doc_id", "run", "part.language", "part.text")


LOOPS = (
    "CASE doc_id % 8 WHEN 0 THEN text || ' ' || repeat('uu', 8) WHEN 1 THEN repeat('xyz', 12) || text "
    "WHEN 2 THEN text || ' ja, ja, ja, ja, ja, ja, ja, ja' WHEN 3 THEN text || ' kata dua kata dua kata dua kata dua' "
    "WHEN 4 THEN text || ' Ja ja! JA ja. Ja? jA ja; ja' ELSE text END"
)


def _reach(same: str, partition: str = "doc_id", order: str = "i") -> str:
    """SQL: how many rows from here on, one after another, meet the condition."""
    return (
        f"coalesce(min(CASE WHEN NOT coalesce({same}, false) THEN {order} END) OVER (PARTITION BY {partition} ORDER BY {order} "
        f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), {order}) - {order}"
    )


def _same(what: str, size: int, partition: str = "doc_id", order: str = "i") -> str:
    return f"{what} = lead({what}, {size}) OVER (PARTITION BY {partition} ORDER BY {order}) AS s{size}"


# The detector by rows instead of patterns: characters, words and comma pieces compared with the ones
# that follow them at a distance.
LOOPING_SQL = rf"""looped AS (SELECT doc_id, {LOOPS} AS text FROM documents),
ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM looped),
ch_same AS (SELECT *, {", ".join(_same("c", k) for k in range(1, 5))} FROM ch),
ch_reach AS (SELECT doc_id, i, c, {", ".join(f"{_reach(f's{k}')} AS r{k}" for k in range(1, 5))} FROM ch_same),
ch_first AS (SELECT doc_id, min(i) FILTER (r1 >= 10 AND (unicode(c) > 127 OR c IN ('a', 'e', 'i', 'o', 'u', '.'))) AS f0,
  {", ".join(f"min(i) FILTER (r{k} >= {10 * k}) AS f{k}" for k in range(1, 5))} FROM ch_reach GROUP BY doc_id),
wd AS (SELECT doc_id, unnest({sql_words('text')}) AS w, generate_subscripts({sql_words('text')}, 1) AS i FROM looped),
wd_plain AS (SELECT *, regexp_replace(lower(w), '[^\pL\pN_]', '', 'g') AS x FROM wd),
wd_same AS (SELECT *, x <> '' AND x = lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS sx,
  {", ".join(_same("w", k) for k in range(1, 10))} FROM wd_plain),
wd_reach AS (SELECT doc_id, i, {_reach('sx')} AS rx, {", ".join(f"{_reach(f's{k}')} AS r{k}" for k in range(1, 10))} FROM wd_same),
wd_size AS (SELECT doc_id, i, rx, CASE {" ".join(f"WHEN r{k} >= {3 * k} THEN {k}" for k in range(1, 10))} END AS size FROM wd_reach),
wd_first AS (SELECT doc_id, count(*) AS n, min(i * 10 + size) AS phrase, min(i) FILTER (rx >= 6) AS again FROM wd_size GROUP BY doc_id),
pc AS (SELECT doc_id, unnest(string_split(text, ',')) AS p, generate_subscripts(string_split(text, ','), 1) AS i FROM looped),
pc_word AS (SELECT doc_id, i, regexp_extract(p, '(?:^|[^\pL\pN_])([\pL\pN_]{{1,5}})$', 1) AS t, regexp_replace(p, '^\s+', '') AS x FROM pc),
pc_hit AS (SELECT doc_id, i, t, t <> '' AND {" AND ".join(f"t = lead(x, {k}) OVER o" for k in range(1, 5))}
  AND starts_with(lead(x, 5) OVER o, t) AS hit FROM pc_word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
pc_first AS (SELECT doc_id, arg_min(t, i) FILTER (hit) AS t FROM pc_hit GROUP BY doc_id),
cut AS (SELECT l.doc_id, text, {sql_words('text')} AS words, f0, f1, f2, f3, f4, n, phrase, again, t,
    regexp_extract(text, '^([\s\S]*?)\.{{10,}}', 1) AS dotted,
    regexp_matches(text, '\.{{10,}}') AND length(text) - length(replace(text, '.', '')) > 10 AS dots
  FROM looped l LEFT JOIN ch_first USING (doc_id) LEFT JOIN wd_first USING (doc_id) LEFT JOIN pc_first USING (doc_id)),
places AS (SELECT *, CASE WHEN f0 IS NOT NULL AND length(text) > 20 THEN 0 WHEN f1 IS NOT NULL THEN 1 WHEN f2 IS NOT NULL THEN 2
    WHEN f3 IS NOT NULL THEN 3 WHEN f4 IS NOT NULL THEN 4 WHEN t IS NOT NULL THEN 5 WHEN n > 3 AND phrase IS NOT NULL THEN 6
    WHEN n > 5 AND again IS NOT NULL THEN 7 WHEN dots THEN 8 ELSE 9 END AS rule FROM cut),
heads AS (SELECT doc_id, text, rule, CASE WHEN rule < 5 THEN left(text, [f0, f1, f2, f3, f4][rule + 1] - 1)
    WHEN rule = 5 THEN left(text, strpos(text, t || ',') - 1) WHEN rule = 6 THEN array_to_string(words[1:phrase // 10 + phrase % 10 - 1], ' ')
    WHEN rule = 7 THEN array_to_string(words[1:again], ' ') WHEN rule = 8 THEN dotted ELSE text END AS head,
    CASE WHEN rule < 5 THEN substr(text, [f0, f1, f2, f3, f4][rule + 1], greatest(1, rule)) ELSE t END AS unit FROM places),
detected AS (SELECT doc_id, rule < 9 AS flagged, CASE WHEN rule IN (6, 7, 9) THEN head WHEN rule = 8 THEN {sql_strip('head')}
    ELSE coalesce(nullif({sql_strip('head')}, ''), unit) END AS cleaned FROM heads)"""


@query("txt27_detect_repetition", f"WITH {LOOPING_SQL} SELECT doc_id, cleaned, flagged FROM detected")
def txt27(spark, d):
    """Loops of every kind are put into five of eight documents."""
    looped = docs(spark, d, F.expr(LOOPS).alias("text"))
    found = looped.select("doc_id", repetition.detect_repetition(F.col("text")).alias("r"))
    return found.select("doc_id", "r.cleaned", "r.flagged")


@query(
    "txt28_fill_template",
    "SELECT c_custkey, 'Saya ' || c_name || ' dari segmen ' || c_mktsegment || '.' AS text FROM customer "
    "WHERE c_custkey % 2 = 0",
)
def txt28(spark, d):
    from tuturan.operators.generate import fill_template

    template = F.when(F.col("c_custkey") % 2 == 0, "Saya {name} dari segmen {party}.").otherwise(
        "Saya {name}, {unknown}."
    )
    filled = fill_template(template, {"name": F.col("c_name"), "party": F.col("c_mktsegment")})
    return table(spark, d, "customer").select("c_custkey", filled.alias("text")).where("text IS NOT NULL")


@query(
    "txt29_paths_and_decimals",
    "SELECT doc_id, CAST(doc_id AS VARCHAR) AS utterance_id, '../audio/' || CAST(doc_id AS VARCHAR) || '.wav' AS path, "
    "CAST(CAST(n_chars * 125 AS DECIMAL(18,0)) / 1000 AS DECIMAL(18,3)) || '' AS duration FROM documents",
)
def txt29(spark, d):
    file = F.concat(F.lit("../audio/"), F.col("doc_id").cast("string"), F.lit(".wav"))
    return docs(
        spark,
        d,
        stem(file).alias("utterance_id"),
        file.alias("path"),
        F.format_string("%.3f", F.col("n_chars") / 8.0).alias("duration"),
    )


@query(
    "txt30_parse_spec",
    "SELECT c_custkey, c_name || '.json' AS path, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS max_tokens FROM customer",
)
def txt30(spark, d):
    spec = F.concat(
        F.col("c_name"),
        F.lit(".json"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(":"), F.col("c_custkey").cast("string"))).otherwise(""),
    )
    path, limit = parse_spec(spec)
    return table(spark, d, "customer").select("c_custkey", path.alias("path"), limit.alias("max_tokens"))


@query(
    "txt31_tokenizers",
    "SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\pL\\pN_'']+|[^\\pL\\pN_\\s]+|\\s+')) AS BIGINT) AS tokens, "
    "CAST(len(list_filter(string_split_regex(regexp_replace(lower(text), '[.,!?;:\"''\\-()\\[\\]{}…«»—–]', ' ', 'g'), '\\s+'), "
    "lambda w: w <> '')) AS BIGINT) AS words FROM documents",
)
def txt31(spark, d):
    return docs(
        spark,
        d,
        F.size(L.dictionary_tokens(F.col("text"))).cast("bigint").alias("tokens"),
        F.size(L.vocabulary_words(F.col("text"))).cast("bigint").alias("words"),
    )


@query(
    "txt32_remove_punctuation",
    "SELECT doc_id, regexp_replace(text, '[^\\pL\\pN_\\s'']', ' ', 'g') AS text FROM documents",
)
def txt32(spark, d):
    return docs(spark, d, X.remove_punctuation(F.col("text")).alias("text"))


# ------------------------------------------------------------------------------------------ Arrow functions
@query("udf1_nfc", "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def udf1(spark, d):
    """Accented letters are taken apart first, so that there is something to compose."""
    apart = arrow.map_text(lambda t: t.str.normalize("NFD"), F.col("text"))
    return docs(spark, d, apart.alias("text")).select("doc_id", arrow.nfc(F.col("text")).alias("text"))


@query("udf2_map_text", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def udf2(spark, d):
    """Letters without their marks, by canonical decomposition, for which there is no built-in."""

    def without_marks(texts):
        return texts.str.normalize("NFD").str.replace(r"[\u0300-\u036f]", "", regex=True)

    return docs(spark, d, arrow.map_text(without_marks, F.col("text")).alias("text"))


@query(
    "udf3_score_batches",
    "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE CAST(length(text) AS VARCHAR) END AS predicted FROM documents",
)
def udf3(spark, d):
    """A stub scorer that fails on every tenth document."""

    def scorer(items):
        if any(item.startswith("0|") for item in items):
            raise RuntimeError("scorer failed")
        return [str(len(item) - 2) for item in items]

    marked = docs(spark, d, F.concat(F.when(F.col("doc_id") % 10 == 0, "0|").otherwise("1|"), F.col("text")).alias("item"))
    return arrow.score_batches(marked, scorer, "item").select("doc_id", "predicted")
