"""SimHash near-duplicates: fingerprints compared exactly, tile against tile, with numpy.

Distinct fingerprints are ordered by the population counts of their four 16-bit quarters and cut
into tiles. The counts of two fingerprints differ, summed over the quarters, by at most their number
of differing bits, so a pair of tiles whose count ranges are further apart than the radius is
skipped, and so is a pair of smaller tiles inside a task. What is left is compared in full with
exclusive-or and bit counts. A task returns a spanning forest of the links it finds, never all pairs
of a group; components are then found over all tasks' forests.

A null or wordless text has fingerprint zero, which is linked like any other. Documents of one
fingerprint are one node, whatever their number. A null ``doc_id`` belongs to a component but never
names it, unless all its ids are null. Repeated rows are kept; other columns are ignored by
``link`` and pass through ``one_of_each``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tuturan.llm.common import append_arrow, free_name, utf8, write_once
from tuturan.llm.components import components

WORDS, SEED, RADIUS = 4, 42, 4
TILE, SMALL = 32_768, 512
HELD_LINKS = 1 << 20  # links in a task's memory before they are reduced to a forest


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(parts) - words + 1].tolist()
        found = (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True))
        hashes = np.fromiter(found, np.uint64, len(starts))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, name: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    def make():
        return lambda batch: [pa.array([fingerprint(x) for x in utf8(batch)], pa.int64())]

    return append_arrow(docs, [(name, T.LongType())], make, keep)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between ``n`` nodes reduced to one link from every other node to its least one."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        np.minimum.at(label, before[a], least)
        np.minimum.at(label, before[b], least)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (label[a] == label[b]).all():
            break
    at = np.nonzero(label != np.arange(n))[0]
    return at, label[at]


def quarters(prints: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters."""
    return np.bitwise_count(prints.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _ordered(prints: np.ndarray) -> np.ndarray:
    q = quarters(prints)
    return prints[np.lexsort((prints, q[:, 3], q[:, 2], q[:, 1], q[:, 0]))]


def _boxes(prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    q, starts = quarters(prints), np.arange(0, len(prints), size)
    return np.minimum.reduceat(q, starts, axis=0), np.maximum.reduceat(q, starts, axis=0)


def compare(x: np.ndarray, y: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two tiles of ordered fingerprints, or within one.

    Places in ``y`` count on from ``len(x)``.
    """
    same = y is None
    y = x if same else y
    n, shift = (len(x), 0) if same else (len(x) + len(y), len(x))
    low_x, high_x = _boxes(x, SMALL)
    low_y, high_y = _boxes(y, SMALL)
    held, count = [], 0
    for i in range(len(low_x)):
        gaps = np.maximum(low_y - high_x[i], 0) + np.maximum(low_x[i] - high_y, 0)
        near = np.nonzero(gaps.sum(1) <= radius)[0]
        left = x[i * SMALL : (i + 1) * SMALL, None]
        for j in near[near >= i] if same else near:
            right = y[None, j * SMALL : (j + 1) * SMALL]
            hit = np.bitwise_count(left ^ right) <= radius
            if hit.any():
                a, b = np.nonzero(hit)
                a, b = a + i * SMALL, b + j * SMALL + shift
                keep = a < b
                held.append((a[keep], b[keep]))
                count += len(held[-1][0])
                if count > HELD_LINKS:
                    held = [forest(*map(np.concatenate, zip(*held, strict=True)), n)]
                    count = len(held[0][0])
    if not count:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(*map(np.concatenate, zip(*held, strict=True)), n)


def _tiles(prints: DataFrame, count: int, tile: int) -> DataFrame:
    """One row for each tile: its fingerprints in order and the range of each quarter's count."""
    limits = [f"{side}{k}" for k in range(4) for side in ("low", "high")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if not own:
            return
        x = _ordered(np.concatenate(own).astype(np.int64).view(np.uint64))
        q = quarters(x)
        box = [v for k in range(4) for v in (int(q[:, k].min()), int(q[:, k].max()))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([x.tobytes()], pa.binary())]
            + [pa.array([v], pa.int32()) for v in box],
            names=["tile", "prints", *limits],
        )

    part = lambda k: F.bit_count(F.shiftrightunsigned("print", 16 * k).bitwiseAND(F.lit(0xFFFF)))
    dealt = prints.repartitionByRange(max(1, -(-count // tile)), *[part(k) for k in range(4)], "print")
    schema = "tile int, prints binary, " + ", ".join(f"{c} int" for c in limits)
    return dealt.mapInArrow(run, schema)


def _near_tiles(tiles: DataFrame, radius: int) -> DataFrame:
    """Pairs of tiles whose count ranges come within the radius, found by the first quarter."""
    box = tiles.drop("prints")
    one = box.select(F.struct(box.columns).alias("x"), F.explode(F.sequence(F.col("low0") - radius, F.col("high0") + radius)).alias("c"))
    two = box.select(F.struct(box.columns).alias("y"), F.explode(F.sequence("low0", "high0")).alias("c"))
    gap = F.lit(0)
    for k in range(4):
        for a, b in (("x", "y"), ("y", "x")):
            gap = gap + F.greatest(F.lit(0), F.col(f"{a}.low{k}") - F.col(f"{b}.high{k}"))
    pairs = one.join(two, "c").where(F.col("x.tile") <= F.col("y.tile")).where(gap <= radius)
    return pairs.select(F.col("x.tile").alias("one"), F.col("y.tile").alias("two")).distinct()


def _compare_tiles(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two, x, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                a, b = compare(x, None if one == two else y, radius)
                both = (x if one == two else np.concatenate([x, y])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[a]), pa.array(both[b])], names=["a", "b"])

    return run


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Forests of the links among the distinct values of ``print``, a written table."""
    tiles = write_once(_tiles(prints, prints.count(), tile), "tiles")
    pairs = write_once(_near_tiles(tiles, radius), "tile-pairs")
    whole = tiles.select("tile", "prints")
    rows = (
        pairs.join(whole.select(F.col("tile").alias("one"), F.col("prints").alias("x")), "one")
        .join(whole.select(F.col("tile").alias("two"), F.col("prints").alias("y")), "two")
        .select("one", "two", "x", "y")
        .repartition(F.col("one"), F.col("two"))
    )
    return rows.mapInArrow(_compare_tiles(radius), "a long, b long")


def group(rows: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``print``, ``root`` and ``component_id`` of a written table of ``doc_id`` and ``print``."""
    nodes = write_once(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(nodes.select("print"), radius, tile))
    known = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    names = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return write_once(known.join(names, "root").select("print", "root", "component_id"), "groups")


def link(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every document."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = write_once(with_fingerprint(chosen, "print", ["doc_id"]), "fingerprints")
    return rows.join(group(rows, radius, tile), "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def _content(docs: DataFrame) -> Column:
    """A digest of a whole row."""
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]
    told = F.to_json(F.struct(*others), {"ignoreNullFields": "false"})
    text = F.coalesce(F.concat(F.lit("="), F.col("text").cast("string")), F.lit(""))
    return F.unhex(F.md5(F.concat(told, text)))


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents with just their own columns, one row of each component: the one with the least
    id and, of rows that repeat it, with the least digest of their content.

    So no component is left without a row, also where rows of one id have different texts, and the
    result does not depend on how the table is partitioned. A row without id is taken last.
    """
    mark = free_name(docs, "near_content")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _content(docs).alias("content"))
    rows = write_once(with_fingerprint(chosen, "print", ["doc_id", "content"]), "fingerprints")
    groups = group(rows, radius).select("print", "root")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")
    least = rows.join(groups, "print").groupBy("root").agg(F.min(order).alias("least"))
    kept = write_once(least.select(F.col("least.content").alias(mark)).distinct(), "kept")
    # rows of one content are copies
    return docs.withColumn(mark, _content(docs)).join(kept, mark, "left_semi").dropDuplicates([mark]).drop(mark)
