"""A Merkle manifest: nested trees of bounded blocks, rolled up by the digits of each leaf's rank.

Leaves are ranked in their group by one range sort. The binary digits of the rank become columns and
are grouped away one after the other, the last first: each grouping puts two child structs into a
parent struct with its hash, so a block of 1,024 leaves ends as one nested struct in one row, after
one shuffle. Block roots are the leaves of the next tier, and the roots of the groups those of a
last tree. From the top down a transform walks each nested struct and an explode emits its leaves
with the hashes beside their way up; a tier's rows meet those of the tier below by grouping, not by
a join.

A hash is the lowercase hex SHA-256 of its inputs one after the other, children as hex text. A run
of one node is hashed alone; a tree of one leaf has that leaf as its root.

Rules: nulls sort first, null groups are a group; leaves of equal order follow their hash, so
repeated rows give the same manifest in any order; an empty table gives no rows; a text may be of
any length, only its hash travels; columns other than those named do not matter, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tuturan.llm.common import write_once

DIGITS = 10  # binary digits of a block: 1,024 nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_EVERY = 7


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    written = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written), F.lit("-"))


def leaf_hash(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def _placed(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Rows with their 0-based place in the order, nulls first. One range sort, written once; places
    come from the counts of its partitions."""
    keys = [F.asc_nulls_first(c) for c in order]
    ranged = write_once(df.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    offsets = write_once(offsets, "offsets")  # one row for each partition of the sort
    local = F.col("_at") - F.shiftleft(part, 33)
    placed = ranged.withColumn("_local", local).withColumn("_part", part).join(offsets, "_part")
    return placed.withColumn(name, F.col("_offset") + F.col("_local")).drop("_at", "_part", "_local", "_offset")


def _at_level(n: Column, level: int) -> Column:
    """Nodes of a tree of n leaves at a level."""
    return F.shiftright(n + F.lit((1 << level) - 1), level)


def _tier(nodes: DataFrame, body: Sequence[str]) -> DataFrame:
    """``tree``, ``block``, ``n``, ``hash`` and the nested ``kids`` of every block.

    ``nodes``: ``tree``, ``n`` (nodes of the tree), ``rank``, ``hash`` and the columns ``body``.
    """
    digits = [f"_d{j}" for j in range(DIGITS)]
    bit = lambda j: F.shiftright("rank", j).bitwiseAND(F.lit(1)).cast("byte")
    rows = (
        nodes.withColumn("block", F.shiftright("rank", DIGITS))
        .withColumns({d: bit(j) for j, d in enumerate(digits)})
        .select("tree", "n", "block", *digits, "hash", F.struct(*body).alias("kids"))
        .repartition("tree", "block")
    )
    for j, digit in enumerate(digits):
        kids = F.array_sort(F.collect_list(F.struct(F.col(digit).alias("side"), "hash", "kids")))
        rows = rows.groupBy("tree", "block", "n", *digits[j + 1 :]).agg(kids.alias("kids"))
        one, two = F.get("kids", F.lit(0)), F.get("kids", F.lit(1))
        both = F.sha2(F.concat(one["hash"], F.coalesce(two["hash"], F.lit(""))), 256)
        is_node = _at_level(F.col("n"), j) > 1
        rows = rows.withColumn("hash", F.when(is_node, both).otherwise(one["hash"]))
    return rows.select("tree", "block", "n", "hash", "kids")


def _walk(kids: Column, n: Column, level: int, block: Column) -> Column:
    """All leaves below the children of a node at ``level``: rank, body and the hashes beside the way up."""
    if level == 0:
        first = F.array().cast("array<struct<hash:string,left:boolean>>")
        return F.array(F.struct(block.alias("rank"), kids.alias("body"), first.alias("path")))

    def below(kid: Column, at: Column) -> Column:
        beside = F.get(kids, F.lit(1) - at)
        step = F.struct(beside["hash"].alias("hash"), (at == 1).alias("left"))
        is_node = _at_level(n, level - 1) > 1
        none = F.array().cast("array<struct<hash:string,left:boolean>>")
        steps = F.when(is_node, F.array(step)).otherwise(none)
        rank = F.shiftleft(block, 1) + kid["side"].cast("long")
        further = lambda leaf: F.struct(
            leaf["rank"].alias("rank"), leaf["body"].alias("body"), F.concat(leaf["path"], steps).alias("path")
        )
        return F.transform(_walk(kid["kids"], n, level - 1, rank), further)

    return F.flatten(F.transform(kids, below))


def _climb(leaves: DataFrame, most: int, body: Sequence[str], name: str) -> list[DataFrame]:
    """The tiers of trees of at most ``most`` leaves, written; the last has one block a tree."""
    tiers = [write_once(_tier(leaves, body), name)]
    while most > 1 << DIGITS:
        most = -(-most // (1 << DIGITS))
        upper = tiers[-1].select(
            "tree", _at_level(F.col("n"), DIGITS).alias("n"), F.col("block").alias("rank"), "hash"
        )
        tiers.append(write_once(_tier(upper, ["hash"]), name))
    return tiers


def _descend(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """``tree``, ``rank``, ``body`` and ``above`` of every leaf; ``above`` (path and whatever else is
    known of a root) comes with ``tree`` from the trees above."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for tier in reversed(tiers):
        known = above.schema["above"].dataType
        mine = tier.select("tree", "block", "n", "kids", F.lit(None).cast(known).alias("above"))
        empty = lambda c: F.lit(None).cast(tier.schema[c].dataType).alias(c)
        theirs = above.select("tree", "block", empty("n"), empty("kids"), "above")
        met = mine.unionByName(theirs).groupBy("tree", "block").agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "above")]
        )
        leaf = F.explode(_walk(F.col("kids"), F.col("n"), DIGITS, F.col("block")))
        out = met.select("tree", "above", leaf.alias("leaf"))
        path = F.concat(F.col("leaf.path"), F.col("above.path"))
        above = out.select(
            "tree",
            F.col("leaf.rank").alias("block"),
            F.col("leaf.body").alias("body"),
            F.col("above").withField("path", path).alias("above"),
        )
    return above.withColumnRenamed("block", "rank")


def proofs(leaves: DataFrame, group: str, order: str, hash: str, carry: Sequence[str] = ()) -> DataFrame:
    """Every leaf with its way up.

    Returns the columns ``group``, ``order`` and ``carry``, ``leaf``, ``path`` (from leaf to root:
    ``hash`` beside the way, null where a run has one node, and ``left``), ``subroot`` and ``root``.
    """
    named = {f"_c{i}": c for i, c in enumerate(carry)}
    held = leaves.select(
        F.col(group).alias("tree"),
        F.col(order).alias("_order"),
        F.col(hash).alias("hash"),
        *[F.col(c).alias(k) for k, c in named.items()],
    )
    held = write_once(held, "leaves")
    placed = _placed(held, ["tree", "_order", "hash", *named], "_place")
    groups = placed.groupBy("tree").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("n"))
    groups = write_once(groups, "groups")
    most, trees = groups.agg(F.max("n"), F.count(F.lit(1))).first()
    of_group = groups.withColumnRenamed("tree", "_tree")
    ranked = placed.join(of_group, F.col("tree").eqNullSafe(F.col("_tree")))
    ranked = ranked.withColumn("rank", F.col("_place") - F.col("_first"))
    body = ["_order", "hash", *named]
    tiers = _climb(ranked.select("tree", "n", "rank", *body), most or 0, body, "blocks")

    subroots = tiers[-1].select(F.col("tree").alias("_group"), "hash")
    one_tree = _placed(subroots, ["_group"], "rank").withColumns(
        {"tree": F.lit(0), "n": F.lit(trees).cast("long")}
    )
    top = _climb(one_tree, trees, ["_group", "hash"], "groups")
    none = F.array().cast("array<struct<hash:string,left:boolean>>")
    root = top[-1].select("tree", F.struct(none.alias("path"), F.col("hash").alias("root")).alias("above"))
    found = _descend(top, root)
    above = found.select(
        F.col("body._group").alias("tree"),
        F.col("above").withField("subroot", F.col("body.hash")).alias("above"),
    )
    out = _descend(tiers, above)
    return out.select(
        F.col("tree").alias(group),
        F.col("body._order").alias(order),
        *[F.col(f"body.{k}").alias(c) for k, c in named.items()],
        F.col("body.hash").alias("leaf"),
        F.col("above.path").alias("path"),
        F.col("above.subroot").alias("subroot"),
        F.col("above.root").alias("root"),
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the hashes beside its way give."""

    def up(below: Column, step: Column) -> Column:
        beside = F.coalesce(step["hash"], F.lit(""))
        return F.sha2(F.when(step["left"], F.concat(beside, below)).otherwise(F.concat(below, beside)), 256)

    return F.aggregate(path, leaf, up)


def digest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, every proof hashed, and checked against rows some of which are changed."""
    number = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.coalesce(number % TAMPERED_EVERY == 0, F.lit(False))
    columns = {c: F.col(c) for c in FIELDS}
    changed = columns | {"n_chars": F.col("n_chars") + 1}
    leaves = docs.select(
        "lang",
        "doc_id",
        leaf_hash(list(columns.values())).alias("leaf"),
        F.when(chosen, leaf_hash(list(changed.values()))).alias("tampered"),
    )
    proven = proofs(leaves, "lang", "doc_id", "leaf", ["tampered"])
    beside = F.concat_ws("", F.transform("path", lambda step: step["hash"]))
    again = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = proven.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), again.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle() -> str:
    def hashed(n_chars: str) -> str:
        values = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    def levels(name: str, leaves: str) -> str:
        return f"""{name}(tree, level, rank, n, hash) AS (
      SELECT tree, 0, rank, n, hash FROM {leaves}
      UNION ALL
      SELECT tree, level + 1, rank // 2, (n + 1) // 2, sha256(hash || coalesce(beside, ''))
      FROM (SELECT *, lead(hash) OVER (PARTITION BY tree ORDER BY rank) AS beside FROM {name} WHERE n > 1)
      WHERE rank % 2 = 0)"""

    def ways(name: str, leaves: str, nodes: str) -> str:
        return f"""{name}(id, tree, level, rank, n, beside, folded) AS (
      SELECT id, tree, 0, rank, n, beside, folded FROM {leaves}
      UNION ALL
      SELECT w.id, w.tree, w.level + 1, w.rank // 2, (w.n + 1) // 2, w.beside || coalesce(s.hash, ''),
        sha256(CASE WHEN w.rank % 2 = 1 THEN s.hash || w.folded ELSE w.folded || coalesce(s.hash, '') END)
      FROM {name} w LEFT JOIN {nodes} s
        ON s.tree IS NOT DISTINCT FROM w.tree AND s.level = w.level AND s.rank = xor(w.rank, 1)
      WHERE w.n > 1)"""

    # crc32 bit by bit: a byte is followed by eight shifts (-1)
    crc = """xor(4294967295, list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
        string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_prepend(
          CAST(ord(c) AS BIGINT), list_transform(range(8), lambda i: CAST(-1 AS BIGINT)))))),
      lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END))"""
    return f"""WITH RECURSIVE leaves AS MATERIALIZED (
      SELECT row_number() OVER () AS id, doc_id, lang AS tree, hash, changed,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, hash) - 1 AS rank,
        count(*) OVER (PARTITION BY lang) AS n
      FROM (SELECT doc_id, lang, {hashed('n_chars')} AS hash,
              CASE WHEN {crc} % {TAMPERED_EVERY} = 0 THEN {hashed('n_chars + 1')} END AS changed
            FROM documents)),
    {levels('nodes', 'leaves')},
    subroots AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY tree NULLS FIRST) AS id, 0 AS tree, tree AS lang, hash,
        row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS rank, count(*) OVER () AS n
      FROM nodes WHERE n = 1),
    {levels('tops', 'subroots')},
    first_ways AS MATERIALIZED (
      SELECT id, tree, rank, n, '' AS beside, coalesce(changed, hash) AS folded FROM leaves),
    {ways('ways', 'first_ways', 'nodes')},
    second_ways AS MATERIALIZED (
      SELECT w.id, s.tree, s.rank, s.n, w.beside, w.folded
      FROM ways w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.tree WHERE w.n = 1),
    {ways('top_ways', 'second_ways', 'tops')}
    SELECT l.doc_id, l.hash AS leaf, s.hash AS subroot, t.hash AS root, sha256(w.beside) AS proof_sha256,
      w.folded AS folded_root, w.folded = t.hash AS verified
    FROM leaves l JOIN top_ways w ON w.id = l.id AND w.n = 1
    JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.tree
    JOIN tops t ON t.n = 1"""


ORACLE = _oracle()
