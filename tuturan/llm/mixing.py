"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only.

The documents of a source, in order of a hash of their id, are cut into blocks of equal size. Target
weights are integers and are used as they are: with weight ``a`` among weights that sum to ``L`` a
source has its ``k``-th block released in slot ``floor(k * L / a)`` and due at ``ceil((k + 1) * L / a)``;
in every slot the released block with the earliest deadline is next. Every deadline is met, so at every
slot of a run of any length each source is less than one block from its exact share. Weights without a
common divisor make a cycle of ``L`` slots after which all shares are met to the block, so one cycle is
scheduled slot by slot and the place of every block is arithmetic on its number. The turns of a source
that has ended fall away, and from the next cycle on the weights are those of the sources left: at most
two kinds of cycle per source and one more. Nothing is dropped or repeated.

Without targets the weight of a source is the square root of its size in parts of about 256, at least
one; these integers are the targets. Given weights may make a cycle of at most ``LONGEST`` slots, else
``ValueError``.

Places within a source are prefix sums over buckets of the hash, so a source of any size is never
in one task.

A null source is a source of its own, a null text has size 1 like an empty one, a null ``doc_id``
sorts first; rows that repeat an id lie side by side. Other columns pass, whatever their names. An
empty table gives no rows. Where targets are given, a source without one gets weight 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tuturan.llm.common import write_once

BLOCK = 8192  # characters in a block
CYCLE = 256  # slots in a full cycle without targets, about; at least four for each source
LONGEST = 16_384  # slots in a cycle of given weights
BUCKET_ROWS = 1024


def _sized(docs: DataFrame, row: Column, digits: int) -> DataFrame:
    hashed = F.md5(F.col("doc_id").cast("string"))
    return docs.select(
        row.alias("row"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"),
        F.coalesce(F.char_length("text") + 1, F.lit(1)).cast("long").alias("size"),
        F.coalesce(hashed, F.lit("")).alias("hash"),
        F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("tie"),
    ).withColumn("bucket", F.substring("hash", 1, digits))


def _sources(sums: DataFrame, targets: dict[str, int] | None) -> DataFrame:
    """Blocks ``n`` and weight ``a``, the blocks in a full cycle, of every source, and where cycles change."""
    totals = sums.groupBy("src").agg(F.sum("size").alias("total"))
    every = Window.partitionBy(F.lit(0))  # one row for each source
    counted = totals.withColumn("n", F.expr(f"(total - 1) div {BLOCK} + 1"))
    if targets is None:
        weight = F.floor(F.sqrt(F.col("total").cast("double"))).cast("long")
        weighed = counted.select(
            "src",
            "n",
            weight.alias("w"),
            F.sum(weight).over(every).alias("all_w"),
            F.greatest(F.lit(CYCLE), 4 * F.count("src").over(every)).alias("slots"),
        )
        shares = weighed.select(
            "src", "n", F.expr("greatest(1L, (2 * slots * w + all_w) div (2 * all_w))").alias("a")
        )
    else:
        weight = F.lit(1).cast("long")
        for name, value in targets.items():
            weight = F.when(F.col("src") == f"={name}", F.lit(int(value)).cast("long")).otherwise(weight)
        listed = counted.withColumn("w", weight).withColumn("ws", F.collect_list("w").over(every))
        # Euclid's steps; ninety are enough for longs
        divisor = """aggregate(ws, 0L, (g, w) -> aggregate(sequence(1, 90), struct(g AS x, w AS y),
            (s, i) -> IF(s.y = 0, s, struct(s.y AS x, s.x % s.y AS y)), s -> s.x))"""
        shares = listed.select("src", "n", F.expr(f"w div {divisor}").alias("a"))
    marks = F.array_sort(
        F.array_distinct(
            F.flatten(F.collect_list(F.expr("array(0L, n div a, n div a + 1)")).over(every))
        )
    )
    return shares.select("src", "n", "a", marks.alias("marks"))


def _check_cycle(sources: DataFrame) -> None:
    slots = sources.agg(F.sum("a")).first()[0] or 0
    if slots > LONGEST:
        raise ValueError(f"target weights make a cycle of {slots} slots; {LONGEST} are allowed")


def _schedule(sources: DataFrame) -> DataFrame:
    """For every kind of cycle, the slot, release and deadline of each block of each source."""
    taken = "CASE WHEN mark < n div a THEN a WHEN mark = n div a THEN n % a ELSE 0L END"
    kinds = (
        sources.select("src", "n", "a", F.explode("marks").alias("mark"))
        .select("src", "mark", "a", F.expr(taken).alias("take"), F.expr("least(n, a * mark)").alias("past"))
        .groupBy("mark")
        .agg(
            F.sum("past").alias("base"),
            F.sum("take").alias("busy"),
            F.sum(F.expr("IF(take > 0, a, 0L)")).alias("slots"),
            F.array_sort(F.collect_list(F.struct("src", "take", "a"))).alias("all_parts"),
        )
        .where("busy > 0")
        .withColumn("parts", F.filter("all_parts", lambda p: p["take"] > 0))
    )
    ready = """coalesce(array_min(transform(parts, (p, i) -> IF(
        s.done[i] < p.take AND (s.done[i] * slots) div p.a <= t,
        struct(((s.done[i] + 1) * slots + p.a - 1) div p.a AS due, i AS i), NULL))).i, -1)"""
    step = f"""transform(array({ready}), c -> named_struct(
        'done', transform(s.done, (x, i) -> IF(i = c, x + 1, x)),
        'picks', concat(s.picks, array(c))))[0]"""
    picks = f"""aggregate(sequence(0L, slots - 1),
        named_struct('done', transform(parts, p -> 0L), 'picks', CAST(array() AS array<int>)),
        (s, t) -> {step}, s -> s.picks)"""
    timed = kinds.withColumn("picks", F.expr(picks))
    slots = timed.select("*", F.posexplode("picks").alias("time", "i")).where("i >= 0")
    place = Window.partitionBy("mark").orderBy("time")
    number = Window.partitionBy("mark", "i").orderBy("time")
    chosen = slots.select(
        "*",
        F.expr("parts[i]").alias("p"),
        (F.row_number().over(place) - 1).cast("long").alias("slot"),
        (F.row_number().over(number) - 1).cast("long").alias("k"),
    )
    # times as slots: an ended source's turns take none
    slot_at = "CAST(size(filter(slice(picks, 1, CAST({} AS INT)), x -> x >= 0)) AS BIGINT)"
    return chosen.select(
        "mark", F.col("p.src").alias("src"), "k", "base", "busy", "slot",
        F.expr(slot_at.format("(k * slots) div p.a")).alias("release"),
        F.expr(slot_at.format("((k + 1) * slots + p.a - 1) div p.a")).alias("deadline"),
    )


def placed(docs: DataFrame, row: Column, targets: dict[str, int] | None = None) -> DataFrame:
    """``row`` of every document with its block, position, release, deadline and start in its source.

    ``targets`` gives integer weights by source; without them a source weighs as the square root of
    its size.
    """
    if targets is not None and min(targets.values(), default=1) < 1:
        raise ValueError("target weights are integers from 1 on")
    digits, room = 1, BUCKET_ROWS * 16
    rows = docs.count()
    while room < rows:
        digits, room = digits + 1, room * 16
    narrow = _sized(docs, F.lit(0), digits)
    sums = write_once(narrow.groupBy("src", "bucket").agg(F.sum("size").alias("size")), "sums")
    sources = write_once(_sources(sums, targets), "sources")
    if targets is not None:
        _check_cycle(sources)
    schedule = write_once(_schedule(sources), "schedule")
    running = Window.partitionBy("src").orderBy("bucket")
    offsets = sums.select(
        "src", "bucket", (F.sum("size").over(running) - F.col("size")).alias("before")
    )
    inside = Window.partitionBy("src", "bucket").orderBy("hash", "id", "size", "tie")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = (
        _sized(docs, row, digits)
        .withColumn("inside", F.sum("size").over(inside) - F.col("size"))
        .join(offsets, ["src", "bucket"])
        .select("row", "src", (F.col("inside") + F.col("before")).alias("start"))
        .withColumn("block", F.expr(f"start div {BLOCK}"))
    )
    return block_places(blocks, sources, schedule)


def block_places(blocks: DataFrame, sources: DataFrame, schedule: DataFrame) -> DataFrame:
    """``row``, ``start``, ``block`` and, by arithmetic on the block's number in ``src``, its
    ``position``, ``release`` and ``deadline``. Both tables are written, so Spark knows their bytes."""
    numbered = (
        blocks.join(sources, "src")
        .withColumn("cycle", F.expr("block div a"))
        .withColumn("k", F.expr("block % a"))
        .withColumn("mark", F.expr("array_max(filter(marks, m -> m <= cycle))"))
        .drop("marks")
    )
    first = F.expr("base + (cycle - mark) * busy")
    return numbered.join(schedule, ["src", "mark", "k"]).select(
        "row",
        "start",
        "block",
        (first + F.col("slot")).alias("position"),
        (first + F.col("release")).alias("release"),
        (first + F.col("deadline")).alias("deadline"),
    )


def digest(docs: DataFrame, targets: dict[str, int] | None = None) -> DataFrame:
    """A row for every document with its place in the mixture."""
    row = F.struct("doc_id", "source")
    return placed(docs, row, targets).select(
        "row.*", "start", "block", "position", "release", "deadline"
    )


def mixed(docs: DataFrame, targets: dict[str, int] | None = None) -> DataFrame:
    """All documents with just their own columns, in the order of the mixture."""
    rows = placed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), targets)
    return rows.orderBy("position", "start").select("row.*")


ORACLE = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS src, coalesce(length(text) + 1, 1) AS size,
         coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS hash
  FROM documents),
starts AS (
  SELECT *, sum(size) OVER (PARTITION BY src ORDER BY hash NULLS FIRST, doc_id NULLS FIRST, size
                            ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
  FROM sized),
totals AS (
  SELECT src, sum(size)::BIGINT AS total, floor(sqrt(sum(size)::DOUBLE))::BIGINT AS w
  FROM sized GROUP BY src),
sources AS (
  SELECT src, (total - 1) // {BLOCK} + 1 AS n,
         greatest(1, (2 * greatest({CYCLE}, 4 * count(*) OVER ()) * w + sum(w) OVER ()::BIGINT)
                     // (2 * sum(w) OVER ()::BIGINT)) AS a
  FROM totals),
marks AS (
  SELECT DISTINCT unnest([0, n // a, n // a + 1]) AS mark FROM sources),
takes AS (
  SELECT mark, src, a, least(n, a * mark) AS past,
         CASE WHEN mark < n // a THEN a WHEN mark = n // a THEN n % a ELSE 0 END AS take
  FROM sources, marks),
kinds AS (
  SELECT mark, sum(past)::BIGINT AS base, sum(take)::BIGINT AS busy,
         sum(CASE WHEN take > 0 THEN a ELSE 0 END)::BIGINT AS slots
  FROM takes GROUP BY mark HAVING sum(take) > 0),
units AS (
  SELECT mark, src, base, busy, k, (k * slots) // a AS release,
         ((k + 1) * slots + a - 1) // a AS deadline
  FROM takes JOIN kinds USING (mark), unnest(range(take)) AS r(k)),
edf AS (
  SELECT mark, 0::BIGINT AS time, NULL::VARCHAR AS src, map([]::VARCHAR[], []::BIGINT[]) AS done
  FROM kinds
  UNION ALL
  SELECT mark, time + 1, best.src,
         CASE WHEN best IS NULL THEN done ELSE map_concat(done, map([best.src], [best.k + 1])) END
  FROM (
    SELECT e.mark, e.time, e.done,
           (SELECT min({{'deadline': u.deadline, 'src': u.src, 'k': u.k}}) FROM units u
            WHERE u.mark = e.mark AND u.release <= e.time
              AND u.k = coalesce(e.done[u.src], 0)) AS best
    FROM edf e JOIN kinds USING (mark) WHERE e.time < slots)),
timed AS (
  SELECT mark, time, src, count(src) OVER (PARTITION BY mark ORDER BY time) AS slot_at FROM edf),
slots AS (
  SELECT mark, src, slot_at - 1 AS slot,
         row_number() OVER (PARTITION BY mark, src ORDER BY time) - 1 AS k
  FROM timed WHERE src IS NOT NULL),
blocks AS (
  SELECT doc_id, source, starts.src, start, start // {BLOCK} AS block,
         (start // {BLOCK}) // a AS cycle, (start // {BLOCK}) % a AS k
  FROM starts JOIN sources USING (src)),
marked AS (
  SELECT *, (SELECT max(mark) FROM marks WHERE mark <= cycle) AS mark FROM blocks)
SELECT doc_id, source, start, block, base + (cycle - mark) * busy + slot AS position,
       base + (cycle - mark) * busy + r.slot_at AS release,
       base + (cycle - mark) * busy + d.slot_at AS deadline
FROM marked JOIN units USING (mark, src, k) JOIN slots USING (mark, src, k)
JOIN timed r ON r.mark = marked.mark AND r.time = units.release
JOIN timed d ON d.mark = marked.mark AND d.time = units.deadline
"""
