"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. The turns of a conversation
are rendered prefix by prefix; where one output continues the last, what is new is the span of the
new turn; where it does not, the template rewrites history, and the turn is marked and its span
starts where the outputs part. A template sees every prefix whole, so the turns and the last output of
one conversation are in memory; nothing is cut off. A template that is no black box can be given as a ``Fold``, its own
state and the next turn: it streams a conversation of any length in bounded memory.

The default template escapes its control strings inside texts and roles, reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import parts

# The strings that mark turns.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPE = {"<": "\\l", "[": "\\b"}
_PLAIN = {"\\\\": "\\", "\\l": "<", "\\b": "["}
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>\n", re.DOTALL)

Turns = list[tuple[str, str]]


def escape(text: str) -> str:
    """Without control strings; ``unescape`` gives the text back."""
    return _CONTROL.sub(lambda m: _ESCAPE[m[0][0]] + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lb]", lambda m: _PLAIN[m[0]], text)


@dataclass(frozen=True)
class Fold:
    """A template that is no black box: ``step(state, role, text)`` gives the next state and what the turn adds; ``start`` makes the first state."""

    start: Callable[[], Any]
    step: Callable[[Any, str, str], tuple[Any, str]]


def marked_turns(turns: Turns) -> str:
    """The default template: each turn between marks."""
    return "".join(f"<s>{escape(role)}[INST]{escape(text)}[/INST]</s>\n" for role, text in turns)


def read_back(span: str) -> tuple[str, str, int, int] | None:
    """(role, text, first, end) of a span of the default template: first and end bound the escaped text inside it."""
    m = _TURN.fullmatch(span)
    return m and (unescape(m[1]), unescape(m[2]), m.start(2), m.end(2))


def _shared(a: str, b: str) -> int:
    """How many code points two strings begin with alike, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if a[low:half] == b[low:half] else (low, half - 1)
    return low


SPANS = "conv_id long, turn long, role string, start long, end long, text_start long, text_end long, in_loss boolean, rewrites boolean, piece string"


def _spans(batches: Iterator[pa.RecordBatch], template: Callable[[Turns], str] | Fold, reader: Callable, trained: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    fold = template if isinstance(template, Fold) else None
    current, turns, before, length, fresh, state = object(), [], "", 0, True, None
    for batch in parts(batches):
        out = []
        for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if fresh or conv != current:
                current, turns, before, length, fresh = conv, [], "", 0, False
                state = fold.start() if fold else None
            if fold:
                before = ""
                state, now = fold.step(state, role or "", text or "")
            else:
                turns.append((role or "", text or ""))
                now = template(list(turns))
            kept = len(before)
            rewrites = not now.startswith(before)
            if rewrites:
                kept = _shared(before, now)
            start = length - (len(before) - kept)
            piece = now[kept:]
            length, before = start + len(piece), now
            told = reader(piece)
            first, end = (start + told[2], start + told[3]) if told else (None, None)
            out.append((conv, turn, told[0] if told else role or "", start, length, first, end, bool(told) and told[0] in trained, rewrites, piece))
        if out:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "turn", "role", "start", "end", "text_start", "text_end", "in_loss", "rewrites", "piece"])


def turn_spans(conversations: DataFrame, template: Callable[[Turns], str] | Fold = marked_turns, reader: Callable = read_back, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row for each turn: its span [start, end) in the conversation's output, in code points, the
    part under the loss mask [text_start, text_end) where ``in_loss``, the new ``piece`` of the output, and
    whether the template changed earlier output.

    Rows of a conversation stand together and in order (turn, then role and text for ties; nulls
    first). Null roles and texts count as empty; a null conv_id is a conversation like any other.
    Repeated rows are turns of their own. An empty table gives an empty result. The work of a black box grows
    with the square of a conversation's turns, that of a ``Fold`` with the turns. A conversation is a sequence, and so one task.
    """
    ship(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(lambda batches: _spans(batches, template, reader, trained), SPANS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    current, state, done = None, None, []

    def close() -> None:
        done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

    for batch in parts(batches):
        for conv, end, in_loss, rewrites, piece in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "end", "in_loss", "rewrites", "piece")), strict=True):
            if state is None or conv != current:
                if state is not None:
                    close()
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
            role, text, _, _ = read_back(piece) or ("", piece, 0, 0)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if in_loss:
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] = end
            state[5] |= rewrites
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
            done.clear()
    if state is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)


def conversation_digests(spans: DataFrame) -> DataFrame:
    """What the output of each conversation says, read back from the pieces that ``turn_spans`` returned.

    ``spans`` must come straight from ``turn_spans``: the rows of a conversation stand together.
    """
    return spans.mapInArrow(_digests, DIGESTS)
