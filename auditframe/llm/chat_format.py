"""Operator 1: chat formatting with a grammar round trip.

Template: every turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. A control string
inside a role or text is escaped by a backslash after its ``<|`` (an escaped one
gets one backslash more), a line break in a role by ``<|nl|>``; the parser takes
exactly one level off, so escaping is reversible. Each turn is rendered, read
back by the parser and compared with its source; where they differ the
conflicting spots are escaped, until both are identical.

Turns are independent of each other in the grammar, so rendering and its check
run row by row. Only reading a conversation back (its digests run over all its
turns in order) walks a conversation, as a stream over sorted rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import Scratch, arrow_map

START, END = "<|im_start|>", "<|im_end|>"
LINE = "<|nl|>"
#: Roles whose texts are under the loss mask.
LOSS_ROLES = ("assistant",)
_CONTROL = re.compile(r"<\|(\\*)(im_start|im_end|nl)\|>")
_ESCAPED = re.compile(r"<\|\\(\\*)(im_start|im_end|nl)\|>")
_TURN = re.compile(r"<\|im_start\|>(?P<role>[^\n]*)\n(?P<text>.*?)<\|im_end\|>\n", re.DOTALL)


def _escape(s: str) -> str:
    return _CONTROL.sub(lambda m: f"<|\\{m[1]}{m[2]}|>", s)


def _unescape(s: str) -> str:
    return _ESCAPED.sub(lambda m: f"<|{m[1]}{m[2]}|>", s)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """Turns of a rendered text: (role, text, begin and end of the escaped text).
    Raises ValueError where the text is not a sequence of turns."""
    turns, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if m is None or any(mark in m[part] for mark in (START, END) for part in ("role", "text")):
            raise ValueError(f"no turn at {at}")
        role = _unescape(m["role"].replace(LINE, "\n"))
        turns.append((role, _unescape(m["text"]), m.start("text"), m.end("text")))
        at = m.end()
    return turns


def render_turn(role: str, text: str) -> tuple[str, int]:
    """(rendered turn, rounds of escaping it took)."""
    shown_role, shown = role, text
    for rounds in range(3):
        out = f"{START}{shown_role}\n{shown}{END}\n"
        try:
            back = parse(out)
        except ValueError:
            back = []
        if [t[:2] for t in back] == [(role, text)]:
            return out, rounds
        if not back or back[0][0] != role or rounds:
            shown_role = _escape(role).replace("\n", LINE)
        shown = _escape(text)
    raise AssertionError("escaping did not reach the source")


def render(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, turn, rendered, mask_start,
    mask_length, rounds); the mask covers the escaped text of loss turns."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out, start, length, rounds = [], [], [], []
        for role, text in zip(batch.column(2), batch.column(3), strict=True):
            rendered, n = render_turn(role.as_py() or "", text.as_py() or "")
            ((back, _, a, b),) = parse(rendered)
            out.append(rendered)
            rounds.append(n)
            start.append(a)
            length.append(b - a if back in LOSS_ROLES else 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(start, pa.int32()),
             pa.array(length, pa.int32()), pa.array(rounds, pa.int32())],
            names=["conv_id", "turn", "rendered", "mask_start", "mask_length", "rounds"])

    return arrow_map(
        rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text"), run,
        "conv_id bigint, turn bigint, rendered string, mask_start int, mask_length int, rounds int")


class _Reader:
    """What is read back of one conversation, turn by turn."""

    def __init__(self):
        self.turns = self.loss = self.chars = self.rounds = 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: str, start: int, length: int, rounds: int) -> None:
        for role, text, _, _ in parse(rendered):
            self.turns += 1
            self.turn_hash.update(f"{role}\n{text}\n".encode())
        masked = _unescape(rendered[start:start + length])
        self.loss += len(masked)
        self.loss_hash.update(masked.encode())
        self.chars += len(rendered)
        self.rounds = max(self.rounds, rounds)

    def row(self) -> tuple:
        return self.turns, self.turn_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.chars, self.rounds


def read_back(rendered: DataFrame) -> DataFrame:
    """One row per conversation, parsed from its rendered turns in order. A task
    holds one turn at a time, however long the conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(done: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "escape_rounds"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds, strict=True)], names=names)

        open_id, reader, done = None, None, []
        for batch in batches:
            for conv, text, a, n, r in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if reader is None or conv != open_id:
                    if reader is not None:
                        done.append((open_id, *reader.row()))
                    open_id, reader = conv, _Reader()
                reader.add(text, a, n, r)
            if done:
                yield emit(done)
                done = []
        if reader is not None:
            yield emit([(open_id, *reader.row())])

    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
    return ordered.mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, escape_rounds int")


def format_chats(scratch: Scratch, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rendered turns, what is read back per conversation).

    Null role or text: empty. Rows are ordered by turn (null first), then by
    rendered text, so repeated turns all stay. Null conv_id: a conversation of
    its own. Extra columns are ignored; an empty table gives an empty result."""
    rendered = scratch.write(render(rows))
    return rendered, read_back(rendered)
