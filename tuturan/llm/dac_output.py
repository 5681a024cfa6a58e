"""Token-id files of directly addressable codes.

Ids are cut into byte chunks by level. Level 0 holds the low byte of every id; a bitmap says which
ids go on, and level ``k + 1`` holds the next byte of just those. A directory of bit counts before
every 512 bits makes the place of an id in the next level one count away, so any id is read from a
few bytes per level and no block is decoded.

Files are Parquet tables of segments: ``part`` and ``segment`` (their order is document order),
``doc_ids``, ``lengths`` and ``codes`` (the coded ids of whole documents, about ``SEGMENT`` ids).
Spark commits them, so a lost executor only repeats its part.

Nulls in ``text`` are empty documents of one end id; a null ``doc_id`` sorts first and is kept; rows
that repeat a ``doc_id`` are all kept, ordered by text; other columns are ignored; an empty table
gives files without segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tuturan.llm.common import texts
from tuturan.llm.tokens import encoder

SEGMENT = 1 << 18
STEP = 64  # bytes of bitmap between two counts of the directory
MAGIC = b"DAC1"

SEGMENTS = (
    "part int, segment int, n_ids long, doc_ids array<long>, lengths array<long>, codes binary"
)
DOCUMENTS = "part int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long"


def encode(ids: np.ndarray) -> bytes:
    """Chunk levels, bitmaps and directories of unsigned 32-bit ids."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    levels = []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little").tobytes()
        bits += b"\0" * (-len(bits) % 8)
        ones = np.bitwise_count(np.frombuffer(bits, np.uint8)).astype(np.uint32)
        steps = np.add.reduceat(ones, np.arange(0, len(ones), STEP)) if len(ones) else ones
        before = np.concatenate([[0], np.cumsum(steps)[:-1]]) if len(steps) else steps
        levels.append((len(rest), rest.astype(np.uint8).tobytes(), bits, before.astype("<u4")))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = [MAGIC, struct.pack("<I", len(levels))]
    for n, chunks, bits, before in levels:
        out += [struct.pack("<QQQ", n, len(bits), len(before)), chunks, bits, before.tobytes()]
    return b"".join(out)


class Codes:
    """Reads ids anywhere in the codes of a segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not directly addressable codes")
        (count,) = struct.unpack_from("<I", data, 4)
        at, self.levels = 8, []
        for _ in range(count):
            n, n_bits, n_before = struct.unpack_from("<QQQ", data, at)
            at += 24
            chunks = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, n_bits, at + n)
            before = np.frombuffer(data, "<u4", n_before, at + n + n_bits)
            at += n + n_bits + 4 * n_before
            self.levels.append((chunks, bits, before))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """The id at a place: one chunk, one bit and one count in each level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, before) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                return value
            start = byte // STEP * STEP
            low = int(bits[byte]) & ((1 << bit) - 1)
            i = int(before[byte // STEP]) + low.bit_count()
            i += int(np.bitwise_count(bits[start:byte]).sum(dtype=np.int64))
        return value

    def run(self, start: int, length: int) -> np.ndarray:
        """The ids of a run; each level is entered by one count and read in order."""
        out = np.zeros(length, np.uint32)
        own = np.arange(length)
        for k, (chunks, bits, before) in enumerate(self.levels):
            if not len(own):
                break
            out[own] |= chunks[start : start + len(own)].astype(np.uint32) << np.uint32(8 * k)
            byte, end = start // 8, (start + len(own) + 7) // 8
            flags = np.unpackbits(bits[byte:end], bitorder="little")
            at = start - 8 * byte
            first = byte // STEP * STEP
            if k + 1 < len(self.levels):
                rank = int(np.bitwise_count(bits[first:byte]).sum(dtype=np.int64))
                start = int(before[byte // STEP]) + rank + int(flags[:at].sum())
            own = own[flags[at : at + len(own)].astype(bool)]
        return out


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, segment: int = SEGMENT):
    """Write the ids of all documents, each with ``end_id`` behind it, in ascending ``doc_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(tokenizer).ids, np.uint32(end_id).tobytes()
        part, number = TaskContext.get().partitionId(), 0
        names, lengths, held, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            codes = encode(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([size], pa.int64()),
                    pa.array([names], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([codes], pa.binary()),
                ],
                names=["part", "segment", "n_ids", "doc_ids", "lengths", "codes"],
            )

        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for key, text in zip(keys, texts(batch), strict=True):
                ids = ids_of(text) + end
                names.append(key)
                lengths.append(len(ids) // 4)
                held.append(ids)
                size += len(ids) // 4
                if size >= segment:
                    yield row()
                    names, lengths, held, size, number = [], [], [], 0, number + 1
        if names:
            yield row()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(run, SEGMENTS).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: its place among all ids, its length and a checksum of its ids.

    The places come from counts of parts and segments; the ids are read from the codes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                codes = Codes(x["codes"])
                local = np.concatenate([[0], np.cumsum(x["lengths"])]).astype(np.int64)
                crcs = [
                    zlib.crc32(codes.run(int(a), int(n)).astype("<u4").tobytes())
                    for a, n in zip(local, x["lengths"], strict=False)
                ]
                k = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["part"]] * k, pa.int32()),
                        pa.array([x["segment"]] * k, pa.int32()),
                        pa.array(x["doc_ids"], pa.int64()),
                        pa.array(local[:-1], pa.int64()),
                        pa.array(x["lengths"], pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["part", "segment", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    files = spark.read.schema(SEGMENTS).parquet(path)
    within = Window.partitionBy("part").orderBy("segment")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (  # one row for each written part
        files.groupBy("part")
        .agg(F.sum("n_ids").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    )
    places = (
        files.select("part", "segment", "n_ids")
        .withColumn("segment_start", F.sum("n_ids").over(within) - F.col("n_ids"))
        .join(parts, "part")
        .select("part", "segment", (F.col("part_start") + F.col("segment_start")).alias("base"))
    )
    return (
        files.select("part", "segment", "doc_ids", "lengths", "codes")
        .mapInArrow(run, DOCUMENTS)
        .join(places, ["part", "segment"])
        .select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_at(spark: SparkSession, path: str, place: int) -> int | None:
    """The id at a place among all ids, read from one segment by its codes; None beyond the end."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    for part in parts:  # a row for each written part
        if place < part["n"]:
            own = files.where(F.col("part") == part["part"])
            sizes = own.select("segment", "n_ids").orderBy("segment").collect()
            for x in sizes:
                if place < x["n_ids"]:
                    row = own.where(F.col("segment") == x["segment"]).select("codes").first()
                    return Codes(bytes(row["codes"]))[place]
                place -= x["n_ids"]
        place -= part["n"]
    return None
