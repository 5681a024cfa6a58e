"""Exact token counts of every prefix of whole texts, for a byte-fallback BPE model of sentencepiece.

The tokens of a prefix are those of a shorter prefix plus one last piece. A run of pieces is what
the library gives exactly if each two neighbours stay apart when they are merged alone, because a
first merge across a border needs no more than the two pieces around it. So one pass over a text
finds, at each place, the only piece that ends there and stays apart from the last piece before it;
the count there is the count before that piece plus its tokens. No prefix is encoded again, and
``count_at`` and ``longest_within`` answer from the stored counts.

The model's own normalisation must leave characters alone but for spaces, else ``PrefixCounter``
raises ``ValueError``. A text is cut where no piece of the vocabulary reaches across (before a run
of spaces, around a line break); each distinct word is worked out once per worker and remembered.

Rules: a null text is empty and has no tokens; a repeated row gives a repeated row; texts of any
length take two bytes a character; only the columns named in the results are returned, so other
columns of the table, whatever their names, do not matter.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tuturan.llm.common import append_arrow, texts

SPACE = "▁"  # how the library writes a space
WORDS_KEPT = 400_000  # remembered words in a worker
LONG_WORD = 64  # longer ones are not remembered
BLOCK = 65_536  # characters of a stored block
CHUNK = 1 << 20  # characters worked on at once, where words allow

_RUN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class _Words(dict):
    """The steps of words that follow one space."""

    def __init__(self, steps):
        super().__init__()
        self.steps = steps

    def __missing__(self, word: str) -> bytes:
        found = self.steps(SPACE + word)
        if len(word) <= LONG_WORD:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = found
        return found


class PrefixCounter:
    """Counts of all prefixes as steps: 16-bit differences between neighbouring prefixes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "Aﬁ  Å\t　x \n "
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError(f"{path} changes characters; prefixes of its texts have no fixed place")
        special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        ids = [i for i in range(model.get_piece_size()) if not any(f(i) for f in special)]
        if not any(model.is_byte(i) for i in range(model.get_piece_size())):
            raise ValueError(f"{path} has no byte pieces")
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ids}
        self.longest = max(map(len, self.score))
        self.cuts = not any(SPACE in p.lstrip(SPACE) or "\n" in p[1:] + p[:-1] for p in self.score)
        # neighbours that some piece joins, and the lengths of pieces by their last three characters
        self.joined = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        ends: dict[str, set[int]] = {}
        for piece in self.score:
            if len(piece) > 2:
                ends.setdefault(piece[-3:], set()).add(len(piece))
        self.sizes = {
            end: (*sorted(found, reverse=True), *self._short_sizes(end)) for end, found in ends.items()
        }
        self.apart: dict[tuple[str, str], bool] = {}
        self.runs: dict[str, bytes] = {}
        self.words = _Words(self.steps_of_run)
        self.line_break = self.steps_of_run("\n")

    def merged(self, text: str) -> list[str]:
        """The pieces of a short string: of all neighbours the best scored are joined, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == -np.inf:
                break
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _short_sizes(self, end: str) -> tuple[int, ...]:
        """Lengths up to two of what may be the last piece of a text with this end."""
        return (2, 1) if end[-2:] in self.score and len(end) > 1 else (1,)

    def _stay_apart(self, before: str, piece: str) -> bool:
        """Are these two pieces, or the second alone after an empty first, what their text gives?"""
        if len(self.apart) >= 4 * WORDS_KEPT:
            self.apart.clear()
        wanted = [before, piece] if before else [piece]
        found = self.apart[before, piece] = self.merged(before + piece) == wanted
        return found

    def steps_of_run(self, run: str) -> bytes:
        """The steps of a run of characters, cut where no piece joins the neighbours."""
        if run[1:].isalpha() and len(run) <= LONG_WORD:
            return self._known_steps(run)
        joined, start, out = self.joined, 0, []
        for end in range(1, len(run) + 1):
            if end == len(run) or run[end - 1 : end + 1] not in joined:
                out.append(self._known_steps(run[start:end]))
                start = end
        return b"".join(out)

    def _known_steps(self, run: str) -> bytes:
        found = self.runs.get(run)
        if found is None:
            found = self._steps(run)
            if len(run) <= LONG_WORD:
                if len(self.runs) >= WORDS_KEPT:
                    self.runs.clear()
                self.runs[run] = found
        return found

    def _steps(self, run: str) -> bytes:
        """The steps of a run, by one pass that looks back one piece at a time."""
        score, sizes, apart = self.score, self.sizes, self.apart
        ring = min(self.longest, len(run)) + 1  # as far back as a piece can begin
        last, count = [""] * ring, [0] * ring  # by place, modulo
        steps, before_total = array("h"), 0
        for end in range(1, len(run) + 1):
            tail = run[end - 3 : end] if end > 2 else run[:end]
            for size in sizes.get(tail) or self._short_sizes(tail):
                if size > end:
                    continue
                start = end - size
                piece = run[start:end]
                if size > 3 and piece not in score:
                    continue
                before = last[start % ring] if start else ""
                alone = apart.get((before, piece))
                if alone or alone is None and self._stay_apart(before, piece):
                    total = (count[start % ring] if start else 0) + (
                        1 if size > 1 or piece in score else len(piece.encode())
                    )
                    break
            else:
                raise AssertionError(f"no piece ends at {end} of {run[:40]!r}")
            last[end % ring], count[end % ring] = piece, total
            steps.append(total - before_total)
            before_total = total
        return steps.tobytes()

    def _chunk(self, text: str) -> bytes:
        if not self.cuts:
            return self.steps_of_run(text)
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.line_break)
            if SPACE * 2 in line or line.endswith(SPACE):
                out += [
                    self.words[run[1:]]
                    if run[0] == SPACE and run[1:2] != SPACE
                    else self.steps_of_run(run)
                    for run in _RUN.findall(line)
                ]
                continue
            first, *words = line.split(SPACE)
            if first:
                out.append(self.steps_of_run(first))
            out += map(self.words.__getitem__, words)
        return b"".join(out)

    def chunks(self, text: str) -> Iterator[np.ndarray]:
        """The steps of a text from its first character on, chunk by chunk."""
        if not text:
            return
        text = SPACE + text.replace(" ", SPACE)  # the library puts a space before every text
        start, first = 0, True
        while start < len(text):
            end = len(text)
            if self.cuts and end - start > CHUNK:
                end = text.find(SPACE, start + CHUNK)
                while end > 0 and text[end - 1] == SPACE:
                    end = text.find(SPACE, end + 1)
                end = len(text) if end < 0 else end
            steps = np.frombuffer(self._chunk(text[start:end]), dtype=np.int16)
            if first:  # the space of the library belongs to the first character
                steps = np.concatenate([[steps[0] + steps[1]], steps[2:]]).astype(np.int16)
            yield steps
            start, first = end, False

    def count(self, text: str) -> int:
        """The count at the last prefix, the whole text."""
        return sum(int(steps.sum(dtype=np.int64)) for steps in self.chunks(text))

    def prefixes(self, text: str) -> np.ndarray:
        """The counts of the prefixes of 0, 1, ... characters."""
        parts = [np.zeros(1, np.int64), *(s.astype(np.int64) for s in self.chunks(text))]
        return np.cumsum(np.concatenate(parts))


@cache
def counter(path: str) -> PrefixCounter:
    """One counter in each worker, with what it remembers."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))

    def make():
        known = counter(path)
        return lambda batch: [pa.array([known.count(t) for t in texts(batch)], pa.int64())]

    counted = append_arrow(sized, [("n_tokens", T.LongType())], make, ["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """The stored counts: per document and block of 65,536 characters a row with ``doc_id``, ``block``,
    ``before`` (the count where the block begins) and ``steps`` (little-endian 16-bit differences).

    An empty text has one block without steps. Write the table where it is asked more than once;
    ids should be unique, else the answers of equal ids run together.
    """
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("block", T.LongType()),
            T.StructField("before", T.LongType()),
            T.StructField("steps", T.BinaryType()),
        ]
    )
    kind = pa.int64() if isinstance(docs.schema["doc_id"].dataType, T.LongType) else None

    def run(batches):
        known = counter(path)
        names = schema.fieldNames()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch)):
                before, block, left = 0, 0, np.zeros(0, np.int16)
                for steps in known.chunks(text):
                    left = np.concatenate([left, steps])
                    while len(left) > BLOCK:
                        part, left = left[:BLOCK], left[BLOCK:]
                        row = [[doc], [block], [before], [part.astype("<i2").tobytes()]]
                        yield pa.RecordBatch.from_arrays([pa.array(row[0], kind), *map(pa.array, row[1:])], names)
                        before, block = before + int(part.sum(dtype=np.int64)), block + 1
                row = [[doc], [block], [before], [left.astype("<i2").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], kind), *map(pa.array, row[1:])], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def count_at(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``asked`` (``doc_id``, ``n_chars``) with ``n_tokens``, the count of that prefix.

    A prefix beyond the end of a text, or of a text that is not stored, has no count (null).
    """
    # the place of the last character; the empty prefix lies before the first block's steps
    place = F.greatest(F.col("n_chars") - 1, F.lit(0))
    asked = asked.withColumn("block", F.floor(place / BLOCK).cast("long"))
    found = asked.join(stored, ["doc_id", "block"], "left")

    def make():
        def work(batch):
            out = []
            rows = zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("n_chars", "block", "before", "steps")))
            for n, block, before, steps in rows:
                if n is None or n < 0 or steps is None or n - block * BLOCK > len(steps) // 2:
                    out.append(None)
                    continue
                part = np.frombuffer(steps, "<i2")[: n - block * BLOCK]
                out.append(before + int(part.sum(dtype=np.int64)))
            return [pa.array(out, pa.int64())]

        return work

    keep = [c for c in asked.columns if c != "block"]
    return append_arrow(found, [("n_tokens", T.LongType())], make, keep)


def longest_within(stored: DataFrame, budget: int) -> DataFrame:
    """``doc_id``, ``n_chars`` and ``n_tokens`` of the longest prefix of at most ``budget`` tokens."""

    def make():
        def work(batch):
            chars, tokens = [], []
            rows = zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("block", "before", "steps")))
            for block, before, steps in rows:
                counts = before + np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int64)
                fits = np.flatnonzero(counts <= budget)
                chars.append(block * BLOCK + int(fits[-1]) + 1 if len(fits) else 0)
                tokens.append(int(counts[fits[-1]]) if len(fits) else 0)
            return [pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())]

        return work

    fields = [("n_chars", T.LongType()), ("n_tokens", T.LongType())]
    best = F.max(F.struct("n_chars", "n_tokens"))
    found = append_arrow(stored, fields, make, ["doc_id"]).groupBy("doc_id").agg(best.alias("_best"))
    return found.select("doc_id", "_best.n_chars", "_best.n_tokens")
