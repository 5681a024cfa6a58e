"""Best-fit packing of documents into token sequences, improved by swaps between underfull bins.

Every document is encoded, ended by one id and, only where it is longer than a sequence, cut into
pieces of exactly that length behind a first piece that may be shorter. Pieces are dealt into shards
by contiguous runs of the order in which the documents are read: files by number and name, rows of a
file as they stand. In each shard best fit fills bins, then a local search moves a piece, or exchanges one for
one or two for one, between underfull bins whenever that increases the sum of squared fills, until
the emptiest bins are empty or nothing helps. The pieces of bins that stay underfull are dealt anew,
those of neighbouring shards together, for further rounds. Sequences are numbered along the same
order, so that a stretch of them holds the sources as that stretch of the documents does.

A null text is an empty document; repeated rows are packed each on its own; other columns are
ignored; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F

from tuturan.llm.common import texts, write_once
from tuturan.llm.tokens import encoder

SHARD = 8192  # pieces in a shard
ROUNDS = 2  # further rounds over the pieces of underfull bins
PASSES = 50  # visits of a bin by the local search of a shard

PIECES = (
    "uid long, run long, file string, block long, "
    "doc_id long, piece int, start long, length long, ids_crc32 long"
)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of ``n`` ids."""
    if n <= size:
        return [(0, n)]
    head = n % size or size
    return [(0, head)] + [(at, size) for at in range(head, n, size)]


def _with_file(docs: DataFrame) -> DataFrame:
    """Ids and texts with the file and the place in it where the task's block begins.

    A table of several sources has no such order; its rows are read as its tasks give them.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text"]
    try:
        return docs.select(
            *columns, F.input_file_name().alias("file"), F.input_file_block_start().alias("block")
        )
    except AnalysisException:
        return docs.select(*columns, F.lit("").alias("file"), F.lit(-1).cast("long").alias("block"))


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, size: int, keep_ids: bool = True
) -> DataFrame:
    """The pieces of every document with the checksum of their ids and, where they are to be kept,
    the ids themselves, little-endian unsigned 32-bit.

    ``run`` is the first ``uid`` of the pieces that a task reads from one block of a file.
    """
    kinds = {"uid": pa.int64(), "run": pa.int64(), "file": pa.string(), "block": pa.int64()}
    kinds |= {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64()}
    kinds |= {"ids_crc32": pa.int64()} | ({"ids": pa.binary()} if keep_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(tokenizer).ids, np.uint32(end_id).tobytes()
        first = uid = TaskContext.get().partitionId() << 33
        place = None
        for batch in batches:
            keys, files, blocks = (
                batch.column(batch.schema.get_field_index(c)).to_pylist()
                for c in ("doc_id", "file", "block")
            )
            rows: list[tuple] = []
            for key, text, file, block in zip(keys, texts(batch), files, blocks, strict=True):
                if (file, block) != place:
                    place, first = (file, block), uid
                ids = ids_of(text) + end
                for k, (at, n) in enumerate(cut(len(ids) // 4, size)):
                    part = ids[4 * at : 4 * (at + n)]
                    row = (uid, first, file, block, key, k, at, n, crc32(part))
                    rows.append((*row, part) if keep_ids else row)
                    uid += 1
            columns = zip(*rows) if rows else [()] * len(kinds)
            made = [pa.array(x, kind) for x, kind in zip(columns, kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(made, names=list(kinds))

    return _with_file(docs).mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


def positions(pieces: DataFrame) -> DataFrame:
    """``uid``, ``length`` and the place in the order of reading of every written piece."""
    runs = pieces.groupBy("run").agg(
        F.first("file").alias("file"), F.first("block").alias("block"), F.count("*").alias("n")
    )
    number = F.expr(r"try_cast(regexp_extract(file, 'part-([0-9]+)[^/]*$', 1) AS bigint)")
    folder = F.regexp_replace("file", "[^/]*$", "")
    ordered = Window.orderBy(folder, number, "file", "block", "run")  # one row for each block of a file
    before = F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = write_once(runs.select("run", (before - F.col("n")).alias("before")), "piece-runs")
    place = F.col("before") + F.col("uid") - F.col("run")
    return pieces.select("uid", "run", "length").join(runs, "run").select(
        "uid", "length", place.alias("position")
    )


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of item numbers: long items first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: a bin has exactly r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        above = rooms >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        room -= n
        if room:
            by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins


def swap_search(bins: list[list[int]], lengths: np.ndarray, size: int, passes: int = PASSES):
    """Empty underfull bins by moves and exchanges, each of which raises the sum of squared fills.

    Works on the emptiest bin first. With ``d`` the length that goes from bin A to bin B, the sum
    grows where ``fill(B) + d > fill(A)``; among all partners the one that fills B most is taken.
    """
    fill = np.array([int(lengths[b].sum()) for b in bins], dtype=np.int64)
    full = [b for b, f in zip(bins, fill, strict=True) if f == size]
    bins = [b for b, f in zip(bins, fill, strict=True) if f < size]
    fill = fill[fill < size]
    least = -(-int(fill.sum()) // size)
    items = np.array([i for b in bins for i in b], dtype=np.int64)
    owner = np.array([k for k, b in enumerate(bins) for _ in b], dtype=np.int64)
    width = lengths[items] if len(items) else np.empty(0, np.int64)
    alive, tried = int((fill > 0).sum()), np.zeros(len(bins), np.int64)
    stuck = np.zeros(len(bins), bool)
    while alive > least:
        open_bins = np.nonzero((fill > 0) & (fill < size) & ~stuck & (tried < passes))[0]
        if not len(open_bins):
            break
        a = int(open_bins[np.argmin(fill[open_bins])])
        tried[a] += 1
        moved = False
        mine = np.nonzero(owner == a)[0]
        mine = mine[np.argsort(-width[mine], kind="stable")]
        others = (owner != a) & (fill[owner] < size)
        room = size - fill[owner]
        for x in mine:  # move
            ok = others & (room >= width[x]) & (fill[owner] + width[x] > fill[a])
            if ok.any():
                to = owner[int(np.argmax(np.where(ok, fill[owner], -1)))]
                fill[a] -= width[x]
                fill[to] += width[x]
                owner[x] = to
                moved = True
                break
        groups = [] if moved else [(x,) for x in mine]
        if not moved:
            top = mine[:16]
            groups += [(top[i], top[j]) for i in range(len(top)) for j in range(i)]
        best: tuple[int, int, int, tuple] | None = None
        for group in groups:  # one for one, two for one
            d = int(width[list(group)].sum()) - width
            ok = others & (d > 0) & (d <= room) & (fill[owner] + d > fill[a])
            if ok.any():
                gain = np.where(ok, fill[owner] + d, -1)
                j = int(np.argmax(gain))
                if best is None or gain[j] > best[0]:
                    best = (int(gain[j]), j, int(d[j]), group)
                if best[0] == size:
                    break
        if best:
            _, j, d, group = best
            to = int(owner[j])
            owner[list(group)] = to
            owner[j] = a
            fill[a] -= d
            fill[to] += d
            moved = True
        if moved:
            alive = int((fill > 0).sum())
            stuck[:] = False if fill[a] == 0 else stuck
        else:
            stuck[a] = True
    kept = [items[owner == k].tolist() for k in range(len(bins)) if fill[k] > 0]
    return full + kept


def _pack_shard(size: int, level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position", ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        places = rows["position"].to_numpy(np.float64)
        bins = swap_search(best_fit(lengths, size), lengths, size)
        bins.sort(key=lambda b: float((places[b] * lengths[b]).sum() / lengths[b].sum()))
        number, offset, left = (np.zeros(len(rows), np.int64) for _ in range(3))
        for k, b in enumerate(bins):
            ends = np.cumsum(lengths[b])
            number[b], offset[b], left[b] = k, ends - lengths[b], size - ends[-1]
        home = int(rows["home"].max()) if len(rows) else 0  # sequences follow those of this shard
        return pd.DataFrame(
            {
                "uid": rows["uid"],
                "length": rows["length"],
                "position": rows["position"],
                "home": home,
                "sequence_id": (home << 24) + (level << 20) + number,
                "offset": offset,
                "room": left,
            }
        )

    return run


def place(pieces: DataFrame, size: int, shard: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """A sequence and an offset for every ``uid`` of a written table of pieces."""
    spark, placed = pieces.sparkSession, None
    count = pieces.count()
    shards = max(1, -(-count // shard))
    home = F.expr(f"position * {shards} div {max(1, count)}")
    dealt = positions(pieces).withColumn("home", home).withColumn("shard", F.col("home"))
    for level in range(rounds + 1):
        packed = dealt.groupBy("shard").applyInPandas(
            _pack_shard(size, level),
            "uid long, length long, position long, home long, sequence_id long, offset long, room long",
        )
        packed = write_once(packed, f"packed-{level}")
        last = shards == 1 or level == rounds
        done = packed if last else packed.where("room = 0")
        done = done.select("uid", "sequence_id", "offset")
        placed = done if placed is None else placed.unionByName(done)
        if last:
            break
        rest = packed.where("room > 0").select("uid", "length", "position", "home")
        sizes = write_once(rest.groupBy("home").agg(F.count("*").alias("n")), "rest-sizes")
        before = F.sum("n").over(Window.orderBy("home")) - F.col("n")  # one row for each shard
        groups = sizes.select("home", F.floor(before / shard).alias("shard"))
        shards = groups.select("shard").distinct().count()
        dealt = rest.join(groups, "home")
    return placed if placed is not None else spark.createDataFrame([], "uid long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 1024, keep_ids: bool = True):
    """The written pieces of all documents, and the place of every piece by ``uid``.

    ``keep_ids=False`` writes checksums only, for who does not ask for ``sequences``.
    """
    pieces = write_once(token_pieces(docs, tokenizer, end_id, size, keep_ids), "pieces")
    return pieces, place(pieces, size)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The ids of every sequence, in order of offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["ids"]))
    packed = pieces.select("uid", "length", "ids").join(placed, "uid")
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))


def digest(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """A row for every piece: its place, and the checksum of its ids."""
    own = pieces.select("uid", "doc_id", "piece", "start", "length", "ids_crc32")
    return own.join(placed, "uid").drop("uid")
