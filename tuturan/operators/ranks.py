"""Exact seeded splits, samples and numberings without sorting a whole group in one task.

Rows get a draw (md5 of key and seed). Per group, rows are first counted by the leading digits of
the draw; only the bucket that holds the last wanted row is looked at closely, by further digits
while it holds many rows, and there equal draws are counted before they are ordered. The result is
one cut draw per group, and the split itself is a comparison on the wide rows. The cuts are written
once, so Spark knows their bytes and broadcasts them where they are small.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tuturan.session import freeze, store

BUCKET_DIGITS = 3
CUT_ROWS = 100_000  # rows of a bucket whose draws are put in order
DRAW_DIGITS = 32
VALIDATION_SHARE = 0.1


def draw(key: Sequence[str], seed: int) -> Column:
    """Seeded pseudo-random sort key of a row."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def _names(by: Sequence[str]) -> list[str]:
    return [f"_g{i}" for i in range(len(by))]


def _same_group(by: Sequence[str]) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(by, _names(by))]


def _rename(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(zip(by, _names(by))))


def _attach(df: DataFrame, small: DataFrame, on: list[Column], how: str) -> DataFrame:
    return df.join(small, reduce(lambda a, b: a & b, on), how)


def cut_draws(
    df: DataFrame, key: Sequence[str], take: Column, by: Sequence[str] = (), seed: int = 42
) -> DataFrame:
    """Per group: the draw of the last row taken, how many rows share it and how many of them are
    needed. ``take`` may use ``_total``, the number of rows in the group."""
    by = list(by)
    narrow = df.select(*by, draw(key, seed).alias("_draw"))
    whole = Window.partitionBy(*by)
    earlier = (Window.unboundedPreceding, -1)
    before = lambda n, order: F.coalesce(
        F.sum(n).over(whole.orderBy(order).rowsBetween(*earlier)), F.lit(0)
    )
    inside, want, digits, most = narrow, take.cast("bigint"), 0, CUT_ROWS + 1
    edges: DataFrame | None = None
    while most > CUT_ROWS and digits < DRAW_DIGITS:
        digits += BUCKET_DIGITS
        carried = [] if edges is None else ["_left"]
        counted = (
            inside.groupBy(*by, *carried, F.substring("_draw", 1, digits).alias("_bucket"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_total", F.sum("_n").over(whole))
            .withColumn("_before", before("_n", "_bucket"))
            .withColumn("_take", F.least(want, F.col("_total")))
            .where(F.col("_take").between(F.col("_before") + 1, F.col("_before") + F.col("_n")))
        )
        left = (F.col("_take") - F.col("_before")).alias("_left")
        edges = store(counted.select(*by, F.col("_bucket").alias("_edge"), left, "_n"), "edges")
        most = edges.agg(F.max("_n")).first()[0] or 0
        on = [*_same_group(by), F.substring("_draw", 1, digits) == F.col("_edge")]
        inside = _attach(narrow, _rename(edges, by), on, "inner").select(*by, "_draw", "_left")
        want = F.col("_left")
    cut = (
        inside.groupBy(*by, "_draw", "_left")
        .agg(F.count(F.lit(1)).alias("_same"))
        .withColumn("_before", before("_same", "_draw"))
        .where(F.col("_left").between(F.col("_before") + 1, F.col("_before") + F.col("_same")))
    )
    need = F.col("_left") - F.col("_before")
    return store(cut.select(*by, F.col("_draw").alias("_cut"), "_same", need.alias("_need")), "cuts")


def _content(df: DataFrame) -> Column:
    """A hash of a whole row."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))


def mark_taken(
    df: DataFrame,
    key: Sequence[str],
    take: Column,
    by: Sequence[str] = (),
    seed: int = 42,
    unique_key: bool = False,
    name: str = "taken",
) -> DataFrame:
    """Add a boolean: is the row among the first ``take`` of its group in the order of the draws?

    Sizes are exact. With ``unique_key=False`` rows sharing the cut draw (copies of one key) are
    told apart by their content, in a second round over just these rows; only equal rows are left
    to their place. So the rows taken do not depend on how the input is partitioned.
    """
    by = list(by)
    helper = ["_draw", "_cut", "_same", "_need", *_names(by)]
    cuts = cut_draws(df, key, take, by, seed)
    drawn = df.withColumn("_draw", draw(key, seed))
    taken = F.coalesce(F.col("_draw") <= F.col("_cut"), F.lit(False))
    if by:
        marked = _attach(drawn, _rename(cuts, by), _same_group(by), "left")
    else:
        single = {c: cuts.select(c).scalar() for c in ("_cut", "_same", "_need")}
        marked = drawn.withColumns(single)
    if unique_key or cuts.where("_need < _same").isEmpty():
        return marked.withColumn(name, taken).drop(*helper)
    tied = F.coalesce(
        (F.col("_draw") == F.col("_cut")) & (F.col("_need") < F.col("_same")), F.lit(False)
    )
    clear = marked.where(~tied).withColumn(name, taken).drop(*helper)
    equal = "_content" in df.columns
    quota, tell = ("_places", "_row") if equal else ("_quota", "_content")
    copies = marked.where(tied).withColumnRenamed("_need", quota).drop(*helper)
    # among equal rows any will do
    copies = copies.withColumn(tell, F.monotonically_increasing_id() if equal else _content(df))
    told = mark_taken(freeze(copies), [tell], F.col(quota), [*by, quota], seed, equal, name)
    return clear.unionByName(told.drop(tell, quota))


def stratified_split(
    df: DataFrame,
    by: Sequence[str],
    key: Sequence[str],
    ratio: float = 0.95,
    seed: int = 42,
    unique_key: bool = False,
) -> DataFrame:
    """Column ``split``: per group floor(n * ratio) rows are ``train``, the others ``val``."""
    take = F.floor(F.col("_total") * F.lit(float(ratio)))
    marked = mark_taken(df, key, take, by, seed, unique_key)
    return marked.withColumn("split", F.when(F.col("taken"), "train").otherwise("val")).drop("taken")


def seeded_sample(
    df: DataFrame,
    n: int,
    key: Sequence[str],
    by: Sequence[str] = (),
    seed: int = 42,
    unique_key: bool = False,
) -> DataFrame:
    """Exactly n rows (per group when ``by`` is given), or all when there are fewer."""
    return mark_taken(df, key, F.lit(n), by, seed, unique_key).where("taken").drop("taken")


def equal_quota(
    df: DataFrame, total: int, groups: int, by: str, key: Sequence[str], seed: int = 42, **options
) -> DataFrame:
    """``total // groups`` rows from every group."""
    return seeded_sample(df, total // groups, key, [by], seed, **options)


def reservoir_pair(
    first: DataFrame, second: DataFrame, total: int, key: Sequence[str], seed: int = 42, **options
) -> DataFrame:
    """Half of the rows from each input; the second gives the odd one."""
    half = total // 2
    return seeded_sample(first, half, key, seed=seed, **options).unionByName(
        seeded_sample(second, total - half, key, seed=seed, **options)
    )


def head_limit(
    train: DataFrame,
    val: DataFrame,
    n: int,
    key: Sequence[Column | str],
    share: float = VALIDATION_SHARE,
    val_key: Sequence[Column | str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` training rows and, of the validation rows, the first ``n * share``, cut to a whole
    number. Spark keeps no more than the limit of every task."""
    kept = int(n * share)
    return train.orderBy(*key).limit(n), val.orderBy(*(key if val_key is None else val_key)).limit(kept)


def shuffle_rows(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows in the order of their draws, as a range sort."""
    return df.orderBy(draw(key, seed), *key)


def number_rows(
    df: DataFrame,
    order: str,
    by: Sequence[str] = (),
    name: str = "number",
    then: Sequence[str] = (),
    unique_key: bool = False,
) -> DataFrame:
    """1-based position in the order of a column, nulls last, global or per group.

    The rows are range-sorted once, by group, order, ``then`` and (unless the key is unique) their
    content, and written with their place in their partition. Positions come from the counts of the
    partitions, and in a group from that of its first row. So the number of partitions grows with
    the data as for any sort, equal values may spread over several, and the result does not depend
    on how the input is partitioned.
    """
    by = list(by)
    keys = [F.asc_nulls_last(c) for c in [*by, order, *then]]
    keys += [] if unique_key else [_content(df)]
    ranged = store(df.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = store(  # one row for each partition of the sort
        ranged.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")),
        "parts",
    )
    local = F.col("_at") - F.shiftleft(part, 33)
    placed = ranged.withColumn("_part", part).join(parts, "_part")
    placed = placed.withColumn("_place", F.col("_offset") + local)
    first = F.lit(0)
    if by:
        start = F.struct("_part", (F.col("_at") - F.shiftleft("_part", 33)).alias("_in"))
        starts = ranged.withColumn("_part", part).groupBy(*by).agg(F.min(start).alias("_s"))
        starts = starts.select(*by, F.col("_s._part").alias("_part"), F.col("_s._in").alias("_in"))
        starts = starts.join(parts, "_part").select(*by, (F.col("_offset") + F.col("_in")).alias("_first"))
        placed = _attach(placed, store(_rename(starts, by), "starts"), _same_group(by), "inner")
        first = F.col("_first")
    number = (F.col("_place") - first + 1).cast("bigint")
    helper = ["_at", "_part", "_offset", "_place", "_first", *_names(by)]
    return placed.withColumn(name, number).drop(*helper)


def number_by_draw(
    df: DataFrame, key: Sequence[str], seed: int = 42, name: str = "number", unique_key: bool = False
) -> DataFrame:
    """1-based position of every row in a seeded shuffle."""
    drawn = df.withColumn("_draw", draw(key, seed))
    return number_rows(drawn, "_draw", name=name, then=key, unique_key=unique_key).drop("_draw")


def work_shares(
    df: DataFrame, parts: int, key: Sequence[str], seed: int = 42, name: str = "share"
) -> DataFrame:
    """Deal shuffled rows out over ``parts`` shares whose sizes differ by at most one."""
    numbered = number_by_draw(df, key, seed, "_number")
    return numbered.withColumn(name, F.pmod(F.col("_number") - 1, F.lit(parts))).drop("_number")


def first_per_key(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """Keep the first row of every key; Spark drops the others before the shuffle.

    Rows are told apart by a 256-bit digest of the key, so a long text is not shuffled as one.
    """
    window = Window.partitionBy("_key").orderBy(*order)
    return (
        df.withColumn("_key", F.unhex(F.sha2(key.cast("string"), 256)))
        .withColumn("_rank", F.row_number().over(window))
        .where("_rank = 1")
        .drop("_key", "_rank")
    )


def top_per_group(
    df: DataFrame, n: int, by: Sequence[str], order: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """First n rows per group; Spark limits every map task to n rows per group as well."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
