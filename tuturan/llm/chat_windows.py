"""Chat formatting in budgeted windows of whole turns.

The turns of a conversation are formatted by a template and cut, by prefix sums of their tokens,
into spans that fit a budget. Every window begins with the system turn and a limited history of
turns that earlier windows had; those are masked, so each assistant text is a target exactly once.
A turn that is longer than the budget has a window to itself, whole.

Control strings inside texts (those of this template and of common ones) get a backslash behind
their first character, one more where there are some already, and lose one when read back.

A long conversation is worked on in chunks by turn number: windows end with a chunk, while history
and the system turn are copied into the next one. So no conversation has to fit into a task.

A null text is empty, a null role is '', a null conversation id is a conversation, null turns come
first; rows with an equal turn are ordered by role and text and all kept; other columns are ignored;
an empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tuturan.llm.tokens import encoder

BUDGET, HISTORY = 1024, 256  # tokens of a window, of its history
CHUNK = 512  # turn numbers in a chunk

_CONTROL = r"(\||/?s>|/?INST\]|</?SYS>>)"
_PLAIN = re.compile(r"([<\[])(\\*)" + _CONTROL)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURN = re.compile(r"<\|([^|\n]*)\|>\n(.*?)<\|end\|>\n", re.S)

WINDOWS = (
    "conv_id long, chunk long, window int, text string, repeated int, n_tokens long, "
    "loss array<struct<start:int,end:int>>"
)
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def format_turn(role: str, text: str) -> str:
    """The turn by the template; the role is percent-encoded, the text escaped."""
    return f"<|{quote(role, safe='')}|>\n{escape(text)}<|end|>\n"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    return [(unquote(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def spans(
    sizes: list[int], fixed: int, budget: int, history: int, first: int = 0
) -> list[tuple[int, int, int]]:
    """History start, start and end of each window over turns of these sizes.

    The ``first`` turns are only history; ``fixed`` tokens are taken in each window.
    """
    sums = np.concatenate([[0], np.cumsum(sizes)])
    out, start = [], first
    while start < len(sizes):
        back = int(np.searchsorted(sums, sums[start] - history, "left"))
        room = max(0, budget - fixed)
        while back < start and sums[start + 1] - sums[back] > room:
            back += 1
        end = max(start + 1, int(np.searchsorted(sums, sums[back] + room, "right")) - 1)
        out.append((back, start, end))
        start = end
    return out


def _windows(rows: list[tuple], budget: int, history: int) -> Iterator[tuple]:
    """Windows of one chunk: rows of kind 0 are the system turn, 1 history, 2 its own turns."""
    system = next((r for r in rows if r[0] == 0), None)
    turns = [r for r in rows if r[0] > 0]
    past = sum(r[0] == 1 for r in turns)
    if past == len(turns):
        return
    fixed = system[4] if system else 0
    sizes = [r[4] for r in turns]
    for number, (back, start, end) in enumerate(spans(sizes, fixed, budget, history, past)):
        own = turns[back:end]
        lead = [system] if system and not any(r[1:4] == system[1:4] for r in own) else []
        text, loss, place = [], [], 0
        for k, r in enumerate(lead + own):
            whole = format_turn(r[2], r[3])
            if r[2] == "assistant" and k >= len(lead) + start - back:
                head = len(format_turn(r[2], "")) - len("<|end|>\n")
                loss.append({"start": place + head, "end": place + len(whole) - len("<|end|>\n")})
            text.append(whole)
            place += len(whole)
        yield number, "".join(text), len(lead) + start - back, sum(r[4] for r in lead + own), loss


def windows(
    turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY, chunk: int = CHUNK
) -> DataFrame:
    """Formatted windows of all conversations, with what repeats and what counts for the loss."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer).ids
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            sizes = [len(ids_of(format_turn(r, t))) // 4 for r, t in pairs]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int64())],
                names=["conv_id", "turn", "role", "text", "tokens"],
            )

    own = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sized = own.mapInArrow(count, "conv_id long, turn long, role string, text string, tokens long")
    sized = sized.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(1 << 62))))
    key = ["conv_id", "chunk"]
    latest = Window.partitionBy(*key).orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    tail = (
        sized.withColumn("behind", F.sum("tokens").over(latest.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("behind") <= history)
        .drop("behind")
        .withColumn("chunk", F.col("chunk") + 1)
    )
    system = (
        sized.where("role = 'system'")
        .groupBy("conv_id")
        .agg(F.min(F.struct("turn", "role", "text", "tokens")).alias("s"))
    )
    places = sized.select(*key).distinct()
    lead = places.join(system, places["conv_id"].eqNullSafe(system["conv_id"])).select(
        places["conv_id"], "s.turn", "s.role", "s.text", "s.tokens", "chunk"
    )
    kinds = [x.withColumn("kind", F.lit(k)) for k, x in enumerate((lead, tail, sized))]
    rows = kinds[2].unionByName(kinds[1]).unionByName(kinds[0])
    order = ["conv_id", "chunk", "kind", "turn", "role", "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def emit(out: list) -> None:
            for number, text, repeated, n, loss in _windows(held, budget, history):
                out.append((*group, number, text, repeated, n, loss))

        for batch in batches:
            out: list[tuple] = []
            for conv, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, part) != group:
                    if held:
                        emit(out)
                    group, held = (conv, part), []
                held.append(tuple(row))
            yield _batch(out)
        if held:
            out = []
            emit(out)
            yield _batch(out)

    dealt = rows.repartition(*key).sortWithinPartitions(*order)
    return dealt.select(*order, "tokens").mapInArrow(cut, WINDOWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), span]
    names = ["conv_id", "chunk", "window", "text", "repeated", "n_tokens", "loss"]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=names
    )


def digest(written: DataFrame) -> DataFrame:
    """A row for every conversation, read back from its windows, which stream in order.

    The hashes of a conversation run over its texts one after another, holding one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv = False, None
        turns = chars = whole = 0
        of_turns, of_loss = hashlib.sha256(), hashlib.sha256()

        def row() -> tuple:
            return conv, turns, of_turns.hexdigest(), chars, of_loss.hexdigest(), whole

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                names=[f.split()[0] for f in DIGEST.split(", ")],
            )

        for batch in batches:
            out = []
            for key, text, repeated, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or key != conv:
                    if started:
                        out.append(row())
                    started, conv, turns, chars, whole = True, key, 0, 0, 0
                    of_turns, of_loss = hashlib.sha256(), hashlib.sha256()
                for role, said in read_turns(text)[repeated:]:
                    turns += 1
                    of_turns.update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    chars += len(said)
                    of_loss.update(said.encode())
                whole += len(text)
            yield batch_of(out)
        if started:
            yield batch_of([row()])

    ordered = written.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "window")
    return ordered.select("conv_id", "text", "repeated", "loss").mapInArrow(run, DIGEST)
