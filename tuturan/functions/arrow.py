"""The few functions without a Spark built-in, as Arrow batches."""

from __future__ import annotations

import io
import sys
import unicodedata
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Code points that NFC leaves alone whatever their neighbours inside this set.
_SETTLED = (
    r"\x{0}-\x{2FF}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{3000}-\x{3029}\x{3041}-\x{3096}"
    r"\x{30A1}-\x{30FA}\x{3400}-\x{9FFF}\x{AC00}-\x{D7A3}\x{FF01}-\x{FFEE}"
)


_AT_ONCE = 1 << 20  # bytes of text turned into Python strings together


def _in_parts(texts: pa.Array, fn: Callable[[pd.Series], pd.Series]) -> pa.Array:
    """A function of a series over an Arrow array, a part of at most ``_AT_ONCE`` bytes (one text at
    least) at a time: strings, and what the function makes on its way, take many times their bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    done, start, before = [], 0, 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, before + _AT_ONCE, side="right")))
        part = texts.slice(start, end - start).to_pandas()
        known = part.notna()
        done.append(pa.array(fn(part[known]).reindex(part.index), pa.string(), from_pandas=True))
        start, before = end, ends[end - 1]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def _nfc_batch(texts: pa.Array) -> pa.Array:
    return _in_parts(texts, lambda part: part.map(lambda t: unicodedata.normalize("NFC", t)))


def nfc(col: Column) -> Column:
    """Canonical composition; only text that may change is sent to Python.

    The one-range test in front spares most characters the walk through all ranges.
    """
    open_text = F.when(col.rlike(rf"(?=[^\x00-\x{{2FF}}])[^{_SETTLED}]"), col)
    return F.coalesce(_nfc_batch(open_text), col)


def map_text(fn: Callable[[pd.Series], pd.Series], col: Column) -> Column:
    """Apply a function of a series of texts to parts of Arrow batches; nulls stay null."""

    @F.arrow_udf(T.StringType())
    def batch(texts: pa.Array) -> pa.Array:
        return _in_parts(texts, fn)

    return batch(col)


def score_batches(
    df: DataFrame,
    scorer: Callable[[list], list],
    inputs: str,
    output: str = "predicted",
    output_type: T.DataType = T.StringType(),
    on_error: object = "",
    batch_size: int = 32,
    error: str | None = None,
) -> DataFrame:
    """Run ``scorer`` over lists of values; a failing batch is retried row by row.

    A row that still fails gets ``on_error``; pass ``None`` to drop such rows. With ``error`` a
    column of that name says why a row failed, null where it did not, so a broken scorer is not
    taken for one that heard nothing.
    """
    added = [T.StructField(output, output_type)]
    added += [T.StructField(error, T.StringType())] if error else []
    schema = T.StructType([*df.schema.fields, *added])

    def score(values: list) -> list:
        try:
            return [(x, True, None) for _, x in zip(values, scorer(values), strict=True)]
        except Exception:
            done = []
            for value in values:
                try:
                    done.append((scorer([value])[0], True, None))
                except Exception as problem:
                    reason = f"{type(problem).__name__}: {problem}"
                    done.append((on_error, on_error is not None, reason))
            return done

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = frame[inputs].tolist()
            rows = []
            for start in range(0, len(values), batch_size):
                rows.extend(score(values[start : start + batch_size]))
            new = {output: [v for v, _, _ in rows]}
            if error:
                new[error] = [why for _, _, why in rows]
            yield frame.assign(**new)[[ok for _, ok, _ in rows]]

    return df.mapInPandas(run, schema)


_TOKENS = 1 << 20  # looked up together


def _replaced(tokens: pa.ListArray, known: pa.Array, values: pa.Array) -> pa.Array:
    """The tokens of each row joined, known ones by their value; a null row is empty."""
    counts = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(counts, dtype=np.int64)
    done, start, before = [], 0, 0
    while start < len(tokens):
        end = max(start + 1, int(np.searchsorted(ends, before + _TOKENS, side="right")))
        own = tokens.slice(start, end - start).flatten()
        pieces = pc.coalesce(values.take(pc.index_in(own, value_set=known)), own)
        offsets = pa.array(np.concatenate([[0], ends[start:end] - before]), pa.int32())
        done.append(pc.binary_join(pa.ListArray.from_arrays(offsets, pieces), ""))
        start, before = end, ends[end - 1]
    return pa.concat_arrays(done)


@F.arrow_udf(T.StringType())
def _replaced_by_part(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    part, held = None, []  # the part that is passing, and its known tokens with their values as they came
    for parts, known, values, tokens in batches:
        ids, done = parts.to_numpy(), [pa.nulls(0, known.type)]
        edges = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
        for start, end in zip(edges, edges[1:]):
            if start < end and ids[start] != part:
                part, held = ids[start], []
            first = end - known.slice(start, end - start).null_count  # of its rows
            if start < first:
                held.append((known.slice(start, first - start), values.slice(start, first - start)))
                done.append(pa.nulls(first - start, known.type))
            if first < end:
                none = pa.nulls(0, known.type)
                held = [tuple(pa.concat_arrays([none, *own]) for own in zip(*held))] if held else [(none, none)]
                done.append(_replaced(tokens.slice(first, end - first), *held[0]))
        yield pa.concat_arrays(done)


def replaced_by_part(part: Column, known: Column, value: Column, tokens: Column) -> Column:
    """Tokens joined, those known in the part by their value; null where no row of tokens stands.

    For rows sorted by ``part``, in each first the ``known`` tokens with a ``value``, then its rows of
    ``tokens``, where ``known`` is null. It goes by what passed before, so no filter may pass it.
    """
    return _replaced_by_part.asNondeterministic()(part, known, value, tokens)


_BIG = 1 << 32  # an edit; a substitution is one more, so ties go to fewer substitutions
_FAR = 1 << 60
_TOGETHER = 512  # short pairs aligned in one step
_SHORT = 64  # words of a short side
_FIRST_BAND = 8
_BLOCK = 4096  # characters compared at once along a diagonal
_NOWHERE = -(1 << 40)


def _without_common_ends(ref: np.ndarray, hyp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal words at both ends are hits in some best alignment with fewest substitutions."""
    for _ in range(2):
        least = min(len(ref), len(hyp))
        unlike = np.nonzero(ref[:least] != hyp[:least])[0]
        start = int(unlike[0]) if len(unlike) else least
        ref, hyp = ref[start:][::-1], hyp[start:][::-1]
    return ref, hyp


def _short_totals(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Costs of many short pairs, row by row of all tables at once."""
    sizes = np.array([(len(r), len(h)) for r, h in pairs], dtype=np.int64)
    rows, width = sizes.max(axis=0)
    refs = np.full((len(pairs), rows), -1, dtype=np.int64)
    hyps = np.full((len(pairs), width), -2, dtype=np.int64)
    for k, (r, h) in enumerate(pairs):
        refs[k, : len(r)], hyps[k, : len(h)] = r, h
    ramp = np.arange(width + 1, dtype=np.int64) * _BIG
    row = np.tile(ramp, (len(pairs), 1))
    out = row[np.arange(len(pairs)), sizes[:, 1]]  # right where the reference is empty
    for i in range(rows):
        step = row + _BIG
        diagonal = row[:, :-1] + np.where(hyps == refs[:, i : i + 1], 0, _BIG + 1)
        np.minimum(step[:, 1:], diagonal, out=step[:, 1:])
        row = np.minimum.accumulate(step - ramp, axis=1) + ramp
        done = np.flatnonzero(sizes[:, 0] == i + 1)
        out[done] = row[done, sizes[done, 1]]
    return out


def _banded_total(ref: np.ndarray, hyp: np.ndarray) -> int:
    """Cost of a long pair inside a band of diagonals, doubled until no better way can leave it.

    A way that leaves a band of w diagonals beyond both corners has at least 2 (w + 1) insertions and
    deletions more than the lengths differ by, so the work grows with the errors and not with the
    product of the lengths.
    """
    n, m, width = len(ref), len(hyp), _FIRST_BAND
    while True:
        low, high = min(0, m - n) - width, max(0, m - n) + width
        ramp = np.arange(high - low + 1, dtype=np.int64) * _BIG
        at = np.arange(low, high + 1)
        row = np.where((at >= 0) & (at <= m), at * _BIG, _FAR)
        left, right = max(0, -low), max(0, n + high - m)
        padded = np.concatenate([np.full(left, -1), hyp, np.full(right, -1)])
        for i in range(n):
            start = i + low + left
            step = row + np.where(padded[start : start + len(row)] == ref[i], 0, _BIG + 1)
            np.minimum(step[:-1], row[1:] + _BIG, out=step[:-1])
            row = np.minimum.accumulate(step - ramp) + ramp
        total = int(row[m - n - low])
        if total // _BIG < abs(m - n) + 2 * (width + 1) or width >= max(n, m):
            return total
        width *= 2


def _edit_totals(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Edit distance in the high bits, fewest substitutions among best alignments in the low bits."""
    pairs = [_without_common_ends(r, h) for r, h in pairs]
    out = np.zeros(len(pairs), dtype=np.int64)
    short = [k for k, (r, h) in enumerate(pairs) if max(len(r), len(h)) <= _SHORT]
    short.sort(key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    for start in range(0, len(short), _TOGETHER):
        part = short[start : start + _TOGETHER]
        out[part] = _short_totals([pairs[k] for k in part])
    for k in set(range(len(pairs))) - set(short):
        out[k] = _banded_total(*pairs[k])
    return out


def _furthest(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance by how far each diagonal gets with 0, 1, 2, ... edits, all diagonals at once."""
    a, b = _without_common_ends(a, b)
    n, m = len(a), len(b)
    if not n or not m:
        return n + m
    a = np.concatenate([a.astype(np.int64), np.full(_BLOCK, -1)])
    b = np.concatenate([b.astype(np.int64), np.full(_BLOCK, -2)])
    reach, first, edits = np.zeros(1, dtype=np.int64), 0, 0  # places in a on the diagonals from first on
    while True:
        diagonals = np.arange(first, first + len(reach))
        limit = np.minimum(n, m - diagonals)
        active = np.flatnonzero((reach >= 0) & (reach < limit))
        size = 8
        while len(active):
            size = max(8, min(size, _BLOCK, (1 << 20) // len(active)))
            at = reach[active][:, None] + np.arange(size)
            unlike = a[at] != b[at + diagonals[active][:, None]]
            run = np.where(unlike.any(axis=1), unlike.argmax(axis=1), size)
            reach[active] += run
            active = active[run == size]
            size *= 4
        if first <= m - n < first + len(reach) and reach[m - n - first] >= n:
            return edits
        edits += 1
        wide = np.concatenate([[_NOWHERE] * 2, reach, [_NOWHERE] * 2])
        reach = np.maximum(np.maximum(wide[:-2], wide[1:-1] + 1), wide[2:] + 1)
        first -= 1
        cut = slice(max(0, -n - first), len(reach) - max(0, first + len(reach) - 1 - m))
        first, reach = first + cut.start, reach[cut]
        limit = np.minimum(n, m - np.arange(first, first + len(reach)))
        reach = np.where(reach < 0, _NOWHERE, np.minimum(reach, limit))


@F.pandas_udf(T.LongType())
def long_text_distance(lefts: pd.Series, rights: pd.Series) -> pd.Series:
    """Character edit distance whose work grows with the errors; null where a text is null."""
    code = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    found = [
        None if a is None or b is None else _furthest(code(a), code(b)) for a, b in zip(lefts, rights)
    ]
    return pd.Series(found, dtype="Int64")


_OPERATIONS = T.StructType(
    [
        T.StructField(name, T.IntegerType())
        for name in ("substitutions", "insertions", "deletions", "hits")
    ]
)


@F.pandas_udf(_OPERATIONS)
def edit_operations(refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
    """Word operations of an optimal alignment, the one with the fewest substitutions."""
    codes: dict[str, int] = {}
    number = lambda words: np.array([codes.setdefault(w, len(codes)) for w in words], dtype=np.int64)
    texts = [((r or "").split(), (h or "").split()) for r, h in zip(refs, hyps)]
    unlike = [k for k, (r, h) in enumerate(texts) if r != h]
    totals = _edit_totals([(number(texts[k][0]), number(texts[k][1])) for k in unlike])
    distance, subs = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    distance[unlike], subs[unlike] = np.divmod(totals, _BIG)
    sizes = np.array([(len(r), len(h)) for r, h in texts], dtype=np.int64).reshape(-1, 2)
    ins = (distance - subs + sizes[:, 1] - sizes[:, 0]) // 2
    dels = distance - subs - ins
    columns = [subs, ins, dels, sizes[:, 0] - subs - dels]
    return pd.DataFrame(dict(zip(_OPERATIONS.names, columns)))


HEADER_SCHEMA = "path string, length bigint, duration double, sample_rate int, channels int, errors array<string>"


def read_wav_headers(files: DataFrame, min_duration: float, max_duration: float) -> DataFrame:
    """Duration, rate and channels of PCM files plus the reasons why a file is not usable."""

    def header(content: bytes) -> tuple[float, int, int, list[str]]:
        try:
            with wave.open(io.BytesIO(content)) as audio:
                rate, channels = audio.getframerate(), audio.getnchannels()
                frame = channels * audio.getsampwidth()
                data = len(audio.readframes(audio.getnframes()))
        except (wave.Error, EOFError, ValueError) as problem:
            return 0.0, 0, 0, [str(problem) or "truncated file"]
        seconds = data / frame / rate
        errors = []
        if seconds < min_duration:
            errors.append(f"Too short: {seconds:.2f}s < {min_duration}s")
        if seconds > max_duration:
            errors.append(f"Too long: {seconds:.2f}s > {max_duration}s")
        return seconds, rate, channels, errors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["duration", "sample_rate", "channels", "errors"]
        types = [pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.string())]
        for batch in batches:  # of file contents one is held at a time, beside the batch as it came
            parsed = [header(content.as_py()) for content in batch.column("content")]
            fields = [pa.array([p[k] for p in parsed], kind) for k, kind in enumerate(types)]
            own = [batch.column("path"), batch.column("length")]
            yield pa.RecordBatch.from_arrays(own + fields, names=["path", "length", *names])

    return files.select("path", "length", "content").mapInArrow(run, HEADER_SCHEMA)


# Workers get these functions by value, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
