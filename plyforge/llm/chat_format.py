"""Conversations as marked-up training text, reversibly.

A turn is ``<turn role="R">BODY</turn>`` and a new line. Within roles and texts a backslash stands
before each backslash, ``<`` and ``"`` of the source, so no text can open or close a turn or a
placeholder. A visitor walks a turn's typed parts in order: text is escaped, while an image, audio clip or document
becomes a placeholder ``<image 0>`` whose reference and expanded token count are recorded as attachment.
The loss mask is the body of each assistant turn.

Turns are rendered row by row. Conversations are put together by a sort on (conversation, turn) and
read as a stream, with a few counters and running digests as state, so a conversation of any length
fits in memory; as digests are sequential, a conversation is one task's work. A null text, part or role is empty and
a part of unknown type an error; rows that tie on the turn are ordered by their formatted text; repeated rows are turns of
their own; conversation ids may be of any type that sorts, null ones are one conversation; no rows give no result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import map_texts

_SPECIAL = re.compile(r'[\\<"]')
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r'<turn role="((?:[^\\"<]|\\.)*)">((?:[^\\<]|\\.|<(?:image|audio|document) \d+>)*)</turn>\n', re.DOTALL)
PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENTS = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("ordinal", pa.int64()), ("tokens", pa.int64())]))


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class PartVisitor:
    """Flattens the parts of one turn; ordinals count the turn's attachments."""

    def __init__(self, patch: int = 28, audio_rate: float = 12.5, page_tokens: int = 512) -> None:
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type']}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        self._place(part, math.ceil((part["width"] or 0) / self.patch) * math.ceil((part["height"] or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._place(part, math.ceil((part["seconds"] or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self._place(part, (part["pages"] or 0) * self.page_tokens)

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"unknown part type {part['type']!r}")

    def _place(self, part: dict, tokens: int) -> None:
        ordinal = len(self.attachments)
        self.out.append(f"<{part['type']} {ordinal}>")
        self.attachments.append({"kind": part["type"], "ref": part["ref"], "ordinal": ordinal, "tokens": tokens})


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_end (code points within formatted; equal where there is no loss), attachments, expanded_tokens.

    parts_col: a column of typed parts (array of PART_TYPE) in place of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            formatted, starts, ends, placed, tokens = [], [], [], [], []
            for role, content in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                visitor = PartVisitor()
                for part in content or [] if parts_col else [{"type": "text", "text": content}]:
                    if part is not None:
                        visitor.visit(part)
                head, body = f'<turn role="{escape(role or "")}">', "".join(visitor.out)
                formatted.append(f"{head}{body}</turn>\n")
                starts.append(len(head))
                ends.append(len(head) + (len(body) if role in trained else 0))
                placed.append(visitor.attachments)
                tokens.append(sum(a["tokens"] for a in visitor.attachments))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(formatted, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(placed, ATTACHMENTS), pa.array(tokens, pa.int64())],
                ["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"],
            )

    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(parts_col or text_col).alias("content"))
    return map_texts(rows, run, f"conv_id {turns.schema[conv_col].dataType.simpleString()}, turn long, formatted string, loss_start long, loss_end long, attachments array<struct<kind:string,ref:string,ordinal:long,tokens:long>>, expanded_tokens long")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, body without its escapes) of each turn; raises where the text is not made of whole turns."""
    found, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return found


class _Conversation:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, start: int, end: int) -> None:
        for role, text in parse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        trained = unescape(formatted[start:end])
        self.loss.update(trained.encode())
        self.loss_chars += len(trained)
        self.chars += len(formatted)


def read_back(formatted: DataFrame) -> DataFrame:
    """What each conversation's formatted text says: turns, their digest, and what is under the loss mask."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema["conv_id"].dataType
    kinds = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for conv, text, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        done.append(_row(key, state))
                    key, state = conv, _Conversation()
                state.add(text, start, end)
            if done:
                yield _batch(done)
        if state is not None:
            yield _batch([_row(key, state)])

    def _row(key: object, s: _Conversation) -> tuple:
        return key, s.n, s.turns.hexdigest(), s.loss_chars, s.loss.hexdigest(), s.chars

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
