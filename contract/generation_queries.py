"""Template generation, quota planning and the incremental builds."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from contract.base import CORPUS, corpus, query, sql_quote, table
from contract.text_queries import MONTH_LIST, WORDS, sql_ms, sql_spell_ms
from tuturan.functions.text import strip_markers
from tuturan.operators import generate as G, joins
from tuturan.plans import synthesis
from tuturan.session import scratch_path, store
from tuturan.streaming import incremental

MIXED = [
    "{honorific} {name} membayar {amount} pada {date}.",
    "Hubungi {name} di talian {phone} sebelum {time}.",
    "{name} dari {party} mendapat {percent} undi.",
    "Nombor rujukan {ref_number} milik {name}, kad {ic_number}.",
    "Seramai {number1} orang bertemu {name} pada hari {day_name} {period}.",
    "Templat rosak {tiada} untuk {name}.",
]
NAMES = ["Selamat datang {name}.", "{honorific} {name} sudah sampai.", "Saya nampak {name} semalam, {party}.", "Umur {name} ialah {number}."]
NUMBERS = ["Jumlahnya {amount} sahaja.", "Tarikh {day} {month_malay} {year}.", "Akaun {account_number} aktif.", "Hubungi {name} segera."]


def draw_sql(row: str, slot: str, low: int, high: int, digits: int = 8) -> str:
    number = f"CAST('0x' || substr(md5('42|' || {row} || '|{slot}'), 1, {digits}) AS BIGINT)"
    return f"({number} % {high - low + 1} + {low})"


def choice_sql(row: str, slot: str, options) -> str:
    listed = "[" + ", ".join(sql_quote(o) for o in options) + "]"
    return f"{listed}[{draw_sql(row, slot, 0, len(options) - 1)} + 1]"


def ranged_sql(row: str, slot: str, ranges) -> str:
    cases = " ".join(
        f"WHEN {i} THEN {draw_sql(row, slot, lo, hi)}" for i, (lo, hi) in enumerate(ranges)
    )
    return f"CASE {draw_sql(row, slot + '_range', 0, len(ranges) - 1)} {cases} END"


def text_of(n: str) -> str:
    return f"CAST({n} AS VARCHAR)"


def slot_sql(row: str) -> dict[str, str]:
    dr = lambda slot, lo, hi: draw_sql(row, slot, lo, hi)
    two = lambda slot, lo, hi: f"lpad({text_of(dr(slot, lo, hi))}, 2, '0')"
    month = f"{MONTH_LIST}[{dr('month', 1, 12)}]"
    year, tenths = dr("year", 2020, 2025), dr("percent", 5, 995)
    rest = f"({year} % 1000)"
    minute = dr("minute", 0, 59)
    whole = f"({tenths} // 10)"
    fraction = f"({tenths} / CAST(10 AS DOUBLE))"
    return {
        "name": "c_name",
        "honorific": "c_mktsegment",
        "party": "'N' || CAST(c_nationkey AS VARCHAR)",
        "amount": f"{sql_ms(ranged_sql(row, 'amount', G.AMOUNT_RANGES))} || ' ringgit'",
        "date": f"{sql_ms(dr('day', 1, 28))} || ' ' || {month} || ' dua ribu ' || {sql_ms(rest)}",
        "day": sql_ms(dr("day", 1, 28)),
        "month_malay": month,
        "year": sql_ms(year),
        "phone": sql_spell_ms(
            f"{choice_sql(row, 'prefix', G.PHONE_PREFIXES)} || {text_of(dr('phone1', 100, 999))} || {text_of(dr('phone2', 1000, 9999))}"
        ),
        "time": f"'pukul ' || {sql_ms(dr('hour', 1, 12))} || CASE WHEN {minute} > 0 THEN ' ' || {sql_ms(minute)} ELSE '' END",
        "percent": f"CASE WHEN {tenths} % 10 = 0 THEN {sql_ms(whole)} || ' peratus' ELSE {sql_ms(whole)} || ' perpuluhan ' || "
        f"{sql_ms(f'CAST(floor(({fraction} - floor({fraction})) * 10) AS BIGINT)')} || ' peratus' END",
        "ref_number": f"'REF ' || {sql_spell_ms(text_of(draw_sql(row, 'ref_number', 100_000, 999_999, 14)))}",
        "account_number": sql_spell_ms(text_of(draw_sql(row, "account_number", 1_000_000_000, 9_999_999_999, 14))),
        "ic_number": sql_spell_ms(
            f"{text_of(dr('ic_year', 60, 99))} || {two('ic_month', 1, 12)} || {two('ic_day', 1, 28)} || {two('ic_place', 1, 99)} || {text_of(dr('ic_serial', 1000, 9999))}"
        ),
        "number1": sql_ms(dr("number1", 1, 1000)),
        "day_name": choice_sql(row, "day_name", G.DAYS),
        "period": choice_sql(row, "period", G.PERIODS),
    }


def filled_sql(row: str, templates, allowed=None) -> str:
    """CASE over the drawn template; a template with an unknown placeholder gives NULL."""
    slots = slot_sql(row)
    if allowed is not None:
        slots = {k: v for k, v in slots.items() if k in allowed}
    cases = []
    for i, template in enumerate(templates):
        parts = re.split(r"\{(\w+)\}", template)
        if any(name not in slots for name in parts[1::2]):
            cases.append(f"WHEN {i} THEN NULL")
            continue
        pieces = [f"({slots[p]})" if j % 2 else sql_quote(p) for j, p in enumerate(parts)]
        cases.append(f"WHEN {i} THEN " + " || ".join(pieces))
    return f"CASE {draw_sql(row, 'template', 0, len(templates) - 1)} {' '.join(cases)} END"


PERSON_SLOTS = ["name", "honorific", "party"]


def generated_sql(kind: str, templates, samples: int, allowed=None) -> str:
    row = f"(c_name || '|' || CAST(sample AS VARCHAR) || '|{kind}')"
    return (
        f"SELECT c_name AS person, sample, {filled_sql(row, templates, allowed)} AS text FROM customer, w, "
        f"(SELECT unnest(range({samples})) AS sample)"
    )


def persons(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("honorific"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("party"),
    )


@query(
    "gen1_mixed_sentences",
    f"WITH {WORDS}, g AS ({generated_sql('mixed', MIXED, 4)}) SELECT person, sample, text FROM g WHERE length(text) >= 30",
)
def gen1(spark, d):
    made = G.generate_sentences(persons(spark, d), MIXED, 4, min_length=30)
    return made.select("person", F.col("sample").cast("bigint").alias("sample"), "text")


@query(
    "gen2_name_sentences",
    f"WITH {WORDS}, g AS ({generated_sql('name', NAMES, 3, PERSON_SLOTS)}) SELECT person, sample, text FROM g WHERE length(text) >= 20",
)
def gen2_names(spark, d):
    made = G.generate_sentences(persons(spark, d), NAMES, 3, kind="name", min_length=20)
    return made.select("person", F.col("sample").cast("bigint").alias("sample"), "text")


@query(
    "gen2_number_sentences",
    f"""WITH {WORDS}, g AS (SELECT o_orderkey, {filled_sql("(CAST(o_orderkey AS VARCHAR) || '|number')", NUMBERS, ['amount', 'day', 'month_malay', 'year', 'account_number'])} AS text FROM orders, w)
SELECT o_orderkey, text FROM g WHERE text IS NOT NULL""",
)
def gen2_numbers(spark, d):
    made = G.generate_number_sentences(table(spark, d, "orders"), NUMBERS, key="o_orderkey")
    return made.select("o_orderkey", "text")


@query(
    "join8_person_template_expansion",
    f"WITH {WORDS}, g AS ({generated_sql('mixed', MIXED, 4)}) SELECT person, CAST(count(*) AS BIGINT) AS sentences FROM g WHERE text IS NOT NULL GROUP BY person",
)
def join8(spark, d):
    made = G.generate_sentences(persons(spark, d), MIXED, 4)
    return made.groupBy("person").agg(F.count(F.lit(1)).alias("sentences"))


@query(
    "gen3_until_target",
    "SELECT CAST(count(*) * 2 AS BIGINT) AS sentences, CAST(count(*) * 2 AS BIGINT) AS distinct_texts FROM customer",
)
def gen3(spark, d):
    """One sentence per person and round until there are twice as many sentences as persons."""
    people = persons(spark, d)
    batch = synthesis.next_batch(people, MIXED, people.count() * 2, 1)
    return batch.agg(
        F.count(F.lit(1)).alias("sentences"), F.countDistinct(joins.text_key(F.col("text"))).alias("distinct_texts")
    )


@query(
    "gen3_few_persons",
    "SELECT CAST(count(*) AS BIGINT) AS sentences, CAST(count(*) AS BIGINT) AS distinct_texts FROM customer",
)
def gen3_few(spark, d):
    """Five names have to give as many sentences as there are customers."""
    people = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    numbers = ["Jumlah {amount} dan {ref_number} untuk {name}."]
    batch = synthesis.next_batch(people, numbers, table(spark, d, "customer").count(), 1)
    return batch.agg(
        F.count(F.lit(1)).alias("sentences"), F.countDistinct(joins.text_key(F.col("text"))).alias("distinct_texts")
    )


@query(
    "gen4_incremental_batch",
    f"""WITH {WORDS}, g AS ({generated_sql('name', NAMES, 4, PERSON_SLOTS)}),
e AS (SELECT DISTINCT text FROM g WHERE sample < 2 AND text IS NOT NULL),
n AS (SELECT DISTINCT text FROM g WHERE sample >= 2 AND text IS NOT NULL AND text NOT IN (SELECT text FROM e))
SELECT text, 'earlier' AS batch FROM e UNION ALL SELECT text, 'new' AS batch FROM n""",
)
def gen4(spark, d):
    """The second batch leaves out what the first one has; both are merged."""
    make = lambda start: G.unique_sentences(
        G.generate_sentences(persons(spark, d), NAMES, 2, kind="name", first_round=start), ["person", "sample"]
    )
    earlier = store(make(0), "earlier")
    new = joins.not_yet_written(make(2), earlier)
    label = lambda df, name: df.select("text", F.lit(name).alias("batch"))
    return joins.concatenate([label(earlier, "earlier"), label(new, "new")])


LANGUAGES = [("malay", 0.60), ("english", 0.20), ("code_switching", 0.20)]
TOPICS = [
    ("greetings_closings", 0.15),
    ("account_inquiry", 0.20),
    ("transaction_status", 0.15),
    ("card_services", 0.15),
    ("loan_applications", 0.10),
    ("online_banking", 0.15),
    ("complaints_feedback", 0.10),
]
SENTENCE_TYPES = ["greeting", "confirmation", "information", "question", "instruction", "apology", "closing"]


def _quota_sql() -> str:
    part = lambda total, w: f"CAST(floor({total} * CAST({w} AS DOUBLE)) AS BIGINT)"
    malay, english = part("total", 0.6), part("total", 0.2)
    topics = [part("language_n", w) for _, w in TOPICS]
    first = "language_n - " + " - ".join(topics[1:])
    names = "[" + ", ".join(f"'{n}'" for n, _ in TOPICS) + "]"
    kinds = "[" + ", ".join(f"'{n}'" for n in SENTENCE_TYPES) + "]"
    return f"""WITH s AS (SELECT s_suppkey, 200 + s_suppkey % 50 AS total FROM supplier),
l AS (SELECT s_suppkey, unnest(['malay', 'english', 'code_switching']) AS language,
  unnest([{malay}, {english}, total - {malay} - {english}]) AS language_n FROM s),
t AS (SELECT s_suppkey, language, unnest({names}) AS topic, unnest([{first}, {', '.join(topics[1:])}]) AS topic_n FROM l WHERE language_n > 0)
SELECT s_suppkey, language, topic, unnest({kinds}) AS sentence_type, CAST(greatest(1, topic_n // {len(SENTENCE_TYPES)}) AS BIGINT) AS n FROM t WHERE topic_n > 0"""


@query("gen5_quota_plan", _quota_sql())
def gen5(spark, d):
    total = 200 + F.col("s_suppkey") % 50
    return G.quota_plan(table(spark, d, "supplier"), total, LANGUAGES, TOPICS, SENTENCE_TYPES, "s_suppkey")


SHARE_TEMPLATES = {
    "malay": ["Selamat {greeting}, apa khabar?", "Baki anda {balance} ringgit.", "Sila tunggu sebentar."],
    "english": ["Good {greeting}, how may I help?", "Please hold the line."],
    "code_switching": ["Ok, saya check dulu ya.", "Sila hold on sebentar.", "Your card dah aktif."],
}
SHARE_VALUES = {
    "malay": {"greeting": ["pagi", "petang", "malam"], "balance": ["lima ratus", "dua ribu"]},
    "english": {"greeting": ["morning", "evening"]},
}


def _share_sql(total: int) -> str:
    row = "(CAST(s_suppkey AS VARCHAR) || '|' || language || '|' || CAST(sample AS VARCHAR))"
    whens = []
    for language, options in SHARE_TEMPLATES.items():
        text = choice_sql(row, "template", options)
        for slot, values in SHARE_VALUES.get(language, {}).items():
            text = f"replace({text}, '{{{slot}}}', {choice_sql(row, slot, values)})"
        whens.append(f"WHEN '{language}' THEN {text}")
    malay, english = int(total * 0.6), int(total * 0.2)
    return f"""WITH p AS (SELECT unnest(['malay', 'english', 'code_switching']) AS language, unnest([{malay}, {english}, {total - malay - english}]) AS n),
r AS (SELECT s_suppkey, language, unnest(range(1, n + 1)) AS sample FROM supplier, p),
t AS (SELECT s_suppkey, language, sample, CASE language {' '.join(whens)} END AS text FROM r)
SELECT s_suppkey, language, CAST(sample AS BIGINT) AS sample, text, CAST(len(string_split(text, ' ')) AS BIGINT) AS word_count FROM t"""


@query("gen6_sentences_by_share", _share_sql(24))
def gen6(spark, d):
    made = G.sentences_by_share(
        table(spark, d, "supplier").withColumn("s_suppkey", F.col("s_suppkey").cast("string")), 24, LANGUAGES, SHARE_TEMPLATES, SHARE_VALUES, "s_suppkey"
    )
    return made.select(
        F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "language", F.col("sample").cast("bigint").alias("sample"), "text", "word_count"
    )


@query(
    "synthetic_manifest",
    """WITH t AS (SELECT *, n_chars / CAST(15 AS DOUBLE) AS seconds FROM documents WHERE doc_id % 4 = 3 AND n_chars / CAST(15 AS DOUBLE) BETWEEN 0.1 AND 600),
s AS (SELECT *, row_number() OVER (ORDER BY md5('/data/' || CAST(doc_id AS VARCHAR) || '.wav|42')) AS r, count(*) OVER () AS n FROM t)
SELECT '/data/' || CAST(doc_id AS VARCHAR) || '.wav' AS audio_filepath, CASE WHEN r <= floor(n * CAST(0.9 AS DOUBLE)) THEN 'train' ELSE 'val' END AS split,
  '<|en|> ' || trim(text, ' \n') AS text FROM s""",
)
def synthetic_manifest(spark, d):
    """Flawed records validated, filtered, split and tagged."""
    from contract.source_queries import flawed_records

    good, _ = synthesis.synthetic_manifest(flawed_records(spark, d).drop("doc_id"), "/data", high=600.0)
    return synthesis.tag_manifest(good, "en", add_field=False).select("audio_filepath", "split", "text")


# ------------------------------------------------------------------------------------------------ streams
def two_batches(spark, d, columns):
    """Folder with a first batch of files and a function that adds the second one."""
    folder = scratch_path(spark, "incoming")
    rows = corpus(spark, d)
    write = lambda part, mode: rows.where(part).select(*columns).write.mode(mode).json(folder)
    write("doc_id % 2 = 0", "overwrite")
    return folder, lambda: write("doc_id % 2 = 1", "append")


@query(
    "str1_resume_build",
    f"WITH {CORPUS} SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM corpus WHERE duration BETWEEN 0.1 AND 600",
)
def str1(spark, d):
    """A build is run, new files arrive, and the second run takes only these."""
    folder, more = two_batches(spark, d, ["doc_id", "text", "duration"])
    output, checkpoint = scratch_path(spark, "built"), scratch_path(spark, "progress")
    prepare = lambda df: df.where("duration BETWEEN 0.1 AND 600").select("doc_id", strip_markers(F.col("text")).alias("text"))
    schema = "doc_id bigint, text string, duration double"
    for step in (None, more):
        if step:
            step()
        stream = incremental.new_files(spark, folder, schema)
        incremental.resume_build(stream, prepare, output, checkpoint).awaitTermination()
    return spark.read.schema("doc_id bigint, text string").parquet(output)


@query(
    "str2_unseen_text",
    "SELECT DISTINCT lower(trim(text, ' \n')) AS text_key FROM documents",
)
def str2(spark, d):
    folder, more = two_batches(spark, d, ["doc_id", "text"])
    output, checkpoint = scratch_path(spark, "unseen"), scratch_path(spark, "progress")
    for step in (None, more):
        if step:
            step()
        stream = incremental.new_files(spark, folder, "doc_id bigint, text string")
        incremental.resume_build(stream, incremental.unseen_text, output, checkpoint).awaitTermination()
    kept = spark.read.schema("doc_id bigint, text string").parquet(output)
    return kept.select(joins.text_key(F.col("text")).alias("text_key"))


@query(
    "str2_append_unseen",
    """WITH d AS (SELECT doc_id, lower(trim(text, ' 
')) AS key FROM documents)
SELECT min(doc_id) FILTER (doc_id % 2 = 0) IS NOT NULL AS early, key AS text_key FROM d GROUP BY key""",
)
def str2_append(spark, d):
    """No state: the second run looks at what the first has written."""
    folder, more = two_batches(spark, d, ["doc_id", "text"])
    output, checkpoint = scratch_path(spark, "unseen"), scratch_path(spark, "progress")
    for step in (None, more):
        if step:
            step()
        stream = incremental.new_files(spark, folder, "doc_id bigint, text string")
        incremental.append_unseen(stream, output, checkpoint, ["doc_id"]).awaitTermination()
    kept = spark.read.schema("doc_id bigint, text string").parquet(output)
    return kept.select((F.col("doc_id") % 2 == 0).alias("early"), joins.text_key(F.col("text")).alias("text_key"))


TEXT_KEY = "lower(trim(text, ' \n'))"
DAY = "INTERVAL 20 DAYS"  # between two triggers


def dated_triggers(spark, d, triggers):
    """A trigger for each part of the documents, twenty days apart; texts are kept for thirty."""
    folder, output, checkpoint = (scratch_path(spark, n) for n in ("dated", "unseen", "progress"))
    docs = table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % triggers).alias("part"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.col("part").cast("int") * F.expr(DAY)
    dated = docs.withColumn("at", at)
    for k in range(triggers):
        dated.where(F.col("part") == k).drop("part").write.mode("append").json(folder)
        stream = incremental.new_files(spark, folder, "doc_id bigint, text string, at timestamp")
        incremental.append_unseen_for(stream, output, checkpoint, ["doc_id"], "at", "30 DAYS").awaitTermination()
    return output


def dated_sql(triggers: int) -> str:
    """Only what the trigger before has written is still remembered."""
    steps = []
    for k in range(triggers):
        fresh = f"SELECT min(doc_id) AS doc_id, {TEXT_KEY} AS text_key FROM documents WHERE doc_id % {triggers} = {k}"
        known = f" AND {TEXT_KEY} NOT IN (SELECT text_key FROM t{k - 1})" if k else ""
        steps.append(f"t{k} AS ({fresh}{known} GROUP BY 2)")
    return ", ".join(steps)


@query(
    "str2_forgotten_texts",
    f"WITH {dated_sql(3)} " + " UNION ALL ".join(f"SELECT doc_id, text_key, {k} AS batch FROM t{k}" for k in range(3)),
)
def str2_forgotten(spark, d):
    """A text of the first trigger is new again in the third, one of the second is not."""
    kept = spark.read.parquet(f"{dated_triggers(spark, d, 3)}/rows")
    return kept.select("doc_id", joins.text_key(F.col("text")).alias("text_key"), F.col("batch").cast("int").alias("batch"))


@query(
    "str2_state_size",
    f"WITH {dated_sql(5)} SELECT 3 AS batch, CAST(count(*) AS BIGINT) AS digests FROM t3 UNION ALL SELECT 4, CAST(count(*) AS BIGINT) FROM t4",
)
def str2_state(spark, d):
    """After five triggers the digests of the last two are held."""
    return incremental.remembered(spark, dated_triggers(spark, d, 5)).withColumn("batch", F.col("batch").cast("int"))


@query(
    "str3_running_totals",
    f"WITH {CORPUS} SELECT source, CAST(count(*) AS BIGINT) AS samples, round(sum(duration), 4) AS total_duration, round(sum(duration) / 60, 4) AS minutes FROM corpus GROUP BY source",
)
def str3(spark, d):
    folder, more = two_batches(spark, d, ["source", "duration"])
    output, checkpoint = scratch_path(spark, "totals"), scratch_path(spark, "progress")
    for step in (None, more):
        if step:
            step()
        stream = incremental.new_files(spark, folder, "source string, duration double")
        totals = incremental.running_totals(stream)
        incremental.publish_totals(totals, output, checkpoint).awaitTermination()
    return incremental.latest_totals(spark, output).withColumns({c: F.round(c, 4) for c in ("total_duration", "minutes")})
