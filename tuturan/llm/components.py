"""Connected components of a table of links, by randomised contraction.

In every round each node joins the neighbour (or itself) with the least hash of that round, and the
links are rewritten between those; the nodes shrink by a constant factor in expectation whatever the
shape of the graph. Minima are aggregated before the shuffle, so a node with very many links is no
hot key, and every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tuturan.llm.common import write_once


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of ``links`` (``a``, ``b`` long); one root a component.

    Null ends and links of a node with itself are ignored; repeated links count once.
    """
    links = write_once(links.select("a", "b").where("a <> b").distinct(), "links")
    maps = []
    while not links.isEmpty():
        ends = F.explode(
            F.array(
                F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                F.struct(F.col("b").alias("u"), F.col("a").alias("v")),
            )
        )
        rank = F.lit(len(maps))
        best = (
            links.select(ends.alias("e"))
            .select("e.u", "e.v")
            .groupBy("u")
            .agg(F.min_by("v", F.xxhash64("v", rank)).alias("v"))
        )
        own = F.xxhash64("u", rank) <= F.xxhash64("v", rank)
        step = write_once(
            best.select(F.col("u").alias("node"), F.when(own, F.col("u")).otherwise(F.col("v")).alias("root")),
            "step",
        )
        maps.append(step)
        a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = links.join(a, "a").join(b, "b").where("ra <> rb")
        links = write_once(
            moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "links",
        )
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps[-1]
    for step in reversed(maps[:-1]):
        above = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = step.join(above, "root", "left").select(
            "node", F.coalesce("top", "root").alias("root")
        )
    return write_once(found, "components")
