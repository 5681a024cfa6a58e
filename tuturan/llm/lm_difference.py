"""Cross-entropy difference of two matched word-pair language models over the words there are.

The target model counts the words and word pairs of documents labelled good (outside the held-out
part), the background model those of all documents. Both share one vocabulary, the distinct words of
all documents, and grow with them: a word, a context and a pair are long hashes, counted as they are.
Counts of the background are scaled to the size of the target, so the same smoothing means the same in
both. A document's own counts are taken out before it is scored. Its score is the mean, over its
tokens, of the target's loss less the background's: the lower, the more it is like the target.

No table of counts is broadcast. Documents are packed into chunks of bounded bytes, a row each, as the
files give them. A chunk asks for its distinct grams, cut into parts by their leading bits; each part is
counted up in one task, over the chunks that ask, and answers with counts in the order in which it was
asked. Answers and texts of a chunk then meet in one task. So a gram that every chunk has is one entry of
each chunk, and of the labels only the places of good documents in their chunks travel.

A null or empty text has no tokens and scores 0. A null ``doc_id`` is scored and never a target;
repeated rows are counted and scored each; other columns are ignored; an empty table gives no rows.
Without target documents the target model is flat over the vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tuturan.llm.common import held_out, utf8, write_once

SMOOTH = 50.0  # tokens of the word model that each context counts on top of its own
FLAT = 0.5  # added to every word
WORDS_KEPT = 400_000  # remembered words in a worker
CHUNK_BYTES = 6 << 20  # of the texts of a chunk; a longer text is one of its own
PART_BYTES = 6 << 20  # of text for each part of the grams, about three million entries
TEXT_BYTES = 1 << 20  # of a text split into words at once

BITS = 56  # of a gram; the lowest two tell its kind, so one in 10^6 of 10^10 grams shares another's
WORD, CONTEXT, PAIR = 1, 2, 3
BEGIN = np.uint64(0)  # hash of the beginning of a text
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
_MIX, _KIND = np.uint64(0x9E3779B97F4A7C15), np.uint64(3)

CHUNKS = "chunk long, ids array<{0}>, sizes array<int>, packed binary"
ASKED = "part int, chunk long, grams binary, target binary, background binary"
ANSWERED = "chunk long, part int, target binary, background binary, words long, all_target long, all_words long"
SCORED = "doc_id {}, n_tokens long, target_loss double, background_loss double, score double"
# Rows that meet by chunk, in this order of parts: places of good documents, answers, the chunk itself.
FLAGS = -1
MET = ["chunk", "part", "good", "target", "background", "ids", "sizes", "packed"]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= WORDS_KEPT:
            self.clear()
        found = self[word] = xxh64_intdigest(word) or 1
        return found


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces that end before white space."""
    start = 0
    while space := _SPACE.search(text, start + TEXT_BYTES):
        yield text[start : space.start()]
        start = space.start()
    yield text[start:]


def word_hashes(text: bytes, known: _Words) -> np.ndarray:
    """The hashes of the words of a text, behind the one of its beginning."""
    parts = [np.array([BEGIN])]
    for piece in _pieces(text):
        words = piece.lower().split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(parts)


def _mixed(x: np.ndarray, kind: int) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    x = ((x ^ (x >> np.uint64(29))) * _MIX) >> np.uint64(64 - BITS)
    return (x & ~_KIND) | np.uint64(kind)


def grams(hashes: np.ndarray) -> np.ndarray:
    """Word, context and pair of every token, in three rows."""
    before, after = hashes[:-1], hashes[1:]
    pair = before * np.uint64(0xC2B2AE3D27D4EB4F) + (after ^ (after >> np.uint64(31)))
    return np.stack([_mixed(after, WORD), _mixed(before, CONTEXT), _mixed(pair, PAIR)])


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest of four widths, which the first byte tells."""
    top = int(counts.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _packed_grams(ordered: np.ndarray) -> bytes:
    """Ordered grams by their differences, in as many bytes as the largest needs."""
    gaps = np.diff(ordered)
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    cut = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + ordered[:1].astype("<u8").tobytes() + cut.tobytes()


def _unpacked_grams(data: bytes) -> np.ndarray:
    cut = np.frombuffer(data, np.uint8, offset=9).reshape(-1, data[0])
    gaps = np.zeros((len(cut), 8), np.uint8)
    gaps[:, : data[0]] = cut
    first = np.frombuffer(data, "<u8", 1, offset=1)
    return np.cumsum(np.concatenate([first, gaps.view("<u8").ravel()]), dtype=np.uint64)


def _batch(rows: list[tuple], schema: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names
    )


def chunks(docs: DataFrame) -> DataFrame:
    """Ids and compressed texts of documents, a row for each chunk; written once."""
    kind = docs.schema["doc_id"].dataType
    schema = CHUNKS.format(kind.simpleString())
    ids_kind = to_arrow_type(kind)
    kinds = [pa.int64(), pa.list_(ids_kind), pa.list_(pa.int32()), pa.binary()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, held, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            packed = pa.compress(b"".join(held), "zstd", asbytes=True)
            return _batch([(chunk, ids, [len(t) for t in held], packed)], schema, kinds)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), utf8(batch), strict=True):
                if held and size + len(text) > CHUNK_BYTES:
                    yield row()
                    chunk, ids, held, size = chunk + 1, [], [], 0
                ids.append(key)
                held.append(text)
                size += len(text)
        if held:
            yield row()

    return write_once(docs.select("doc_id", "text").mapInArrow(pack, schema), "chunks")


def _texts(sizes: list[int], packed: bytes) -> list[bytes]:
    whole, out, at = pa.decompress(packed, sum(sizes), "zstd", asbytes=True), [], 0
    for n in sizes:
        out.append(whole[at : at + n])
        at += n
    return out


def flags(packed: DataFrame, labels: DataFrame) -> DataFrame:
    """The places of good documents in their chunks, outside the held-out part.

    The labels grow with the documents, so they are never broadcast.
    """
    good = labels.where(F.col("quality").eqNullSafe(1) & ~held_out()).select("doc_id").distinct().hint("merge")
    places = packed.select("chunk", F.posexplode("ids").alias("place", "doc_id"))
    found = places.join(good, "doc_id").groupBy("chunk").agg(F.collect_list("place").alias("good"))
    return write_once(found, "good-places")


def _met(*kinds: DataFrame) -> DataFrame:
    """Rows of several kinds side by side, those of a chunk together, the chunk itself last."""
    whole = None
    for rows in kinds:
        whole = rows if whole is None else whole.unionByName(rows, allowMissingColumns=True)
    whole = whole.select(*[c for c in MET if c in whole.columns])
    return whole.repartition("chunk").sortWithinPartitions("chunk", F.asc_nulls_last("part"))


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[bool], dict]]:
    """Answers, whether each document is good, and the row of the chunk itself."""
    answers, good = [], set()
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] == FLAGS:
                good = set(row["good"])
            elif row["part"] is not None:
                answers.append(row)
            else:
                yield answers, [k in good for k in range(len(row["sizes"]))], row
                answers, good = [], set()


def _grams_of(row: dict, known: _Words) -> list[np.ndarray]:
    return [grams(word_hashes(t, known)) for t in _texts(row["sizes"], row["packed"])]


def _cuts(unique: np.ndarray, bits: int) -> np.ndarray:
    """Places in ordered grams where the parts begin, and the end."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(BITS - bits)
    return np.concatenate([[0], np.searchsorted(unique, edges), [len(unique)]]).astype(np.int64)


def asked(packed: DataFrame, good: DataFrame, bits: int) -> DataFrame:
    """What every chunk asks of every part: its distinct grams in order, and how often it has them."""
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for _, told, row in _by_chunk(batches):
            found = _grams_of(row, known)
            of_target = np.repeat(told, [g.size for g in found])
            every = np.concatenate([g.ravel() for g in found])
            unique, at = np.unique(every, return_inverse=True)
            background = np.bincount(at, minlength=len(unique))
            target = np.bincount(at[of_target], minlength=len(unique))
            cuts, out = _cuts(unique, bits), []
            for part, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if b > a:
                    asks = (_packed_grams(unique[a:b]), _packed(target[a:b]), _packed(background[a:b]))
                    out.append((part, row["chunk"], *asks))
            yield _batch(out, ASKED, kinds)

    own = _met(packed.withColumn("part", F.lit(None).cast("int")), good.withColumn("part", F.lit(FLAGS)))
    return own.mapInArrow(run, ASKED)


def answered(asks: DataFrame) -> DataFrame:
    """For every ask the counts of its grams over all chunks, in its order; and for every part, with a
    null chunk, its distinct words and the tokens of target and background."""
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def add_up(part: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        wanted = [_unpacked_grams(g) for _, g, _, _ in held]
        sizes, every = [len(g) for g in wanted], np.concatenate(wanted)
        unique, at = np.unique(every, return_inverse=True)
        totals = []
        for k in (2, 3):
            counts = np.concatenate([_unpacked(row[k]) for row in held])
            totals.append(np.bincount(at, weights=counts, minlength=len(unique)).astype(np.int64))
        words = (unique & _KIND) == WORD
        sums = [int(words.sum()), *(int(t[words].sum()) for t in totals)]
        yield _batch([(None, part, None, None, *sums)], ANSWERED, kinds)
        start = 0
        for (chunk, *_), size in zip(held, sizes, strict=True):
            own = at[start : start + size]
            start += size
            yield _batch([(chunk, part, _packed(totals[0][own]), _packed(totals[1][own]), 0, 0, 0)], ANSWERED, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != part:
                    if held:
                        yield from add_up(part, held)
                    part, held = own, []
                held.append(tuple(row))
        if held:
            yield from add_up(part, held)

    return asks.repartition("part").sortWithinPartitions("part", "chunk").mapInArrow(run, ANSWERED)


class Models:
    """What both models know besides the counts: tokens, their scale, and the size of the vocabulary."""

    def __init__(self, vocabulary: int, target: int, background: int):
        self.scale = np.array([1.0, target / background if target and background else 1.0])
        self.sizes = np.array([target, background]) * self.scale
        self.vocabulary = max(1, vocabulary)

    def losses(self, found: np.ndarray, counts: list[np.ndarray], in_target: bool) -> tuple[int, float, float]:
        """Tokens of a text and its mean losses. ``found``: the numbers of its words, contexts and
        pairs; ``counts``: how often each numbered gram occurs in target and background."""
        n = found.shape[1]
        if not n:
            return 0, 0.0, 0.0
        _, at, times = np.unique(found, return_inverse=True, return_counts=True)
        own = times[at.reshape(found.shape)]
        out = []
        for k in range(2):
            less = self.scale[k] if k or in_target else 0.0
            word, context, pair = np.maximum(counts[k][found] * self.scale[k] - less * own, 0.0)
            flat = FLAT * min(1.0, self.scale[1])
            size = max(0.0, self.sizes[k] - less * n)
            unigram = (word + flat) / (size + flat * self.vocabulary)
            out.append(float(-np.log((pair + SMOOTH * unigram) / (context + SMOOTH)).mean()))
        return n, out[0], out[1]


def score(packed: DataFrame, good: DataFrame, answers: DataFrame, models: Models) -> DataFrame:
    """Tokens, mean losses and their difference for every document."""
    kind = packed.schema["ids"].dataType.elementType
    schema = SCORED.format(kind.simpleString())
    kinds = [to_arrow_type(kind), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for replies, told, row in _by_chunk(batches):
            none = [np.empty(0, np.int64)]
            counts = [np.concatenate(none + [_unpacked(r[k]) for r in replies]) for k in ("target", "background")]
            found = _grams_of(row, known)
            _, at = np.unique(np.concatenate([g.ravel() for g in found]), return_inverse=True)
            out, start = [], 0
            for doc, flag, own in zip(row["ids"], told, found, strict=True):
                numbers = at[start : start + own.size].reshape(own.shape)
                start += own.size
                n, target, background = models.losses(numbers, counts, flag)
                out.append((doc, n, target, background, target - background))
            yield _batch(out, schema, kinds)

    replies = answers.where("chunk IS NOT NULL").select("chunk", "part", "target", "background")
    met = _met(packed.withColumn("part", F.lit(None).cast("int")), good.withColumn("part", F.lit(FLAGS)), replies)
    return met.mapInArrow(run, schema)


def difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    packed = chunks(docs)
    good = flags(packed, labels)
    size = packed.agg(F.sum(F.expr("aggregate(sizes, 0L, (s, n) -> s + n)"))).first()[0] or 0
    bits = max(0, (size // PART_BYTES).bit_length())
    answers = write_once(answered(asked(packed, good, bits)), "answers")
    sums = answers.where("chunk IS NULL").agg(*[F.sum(c) for c in ("words", "all_target", "all_words")]).first()
    return score(packed, good, answers, Models(*[x or 0 for x in sums]))
