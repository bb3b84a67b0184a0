"""Chat formatting with typed content parts (operator 7).

A visitor walks a message's parts (text, image, audio, document) and flattens them into one string: texts are escaped, other parts
become numbered placeholders in order, with an attachment record (kind, reference, place in the formatted text,
tokens that the placeholder expands to). A template marks the turns. Control strings inside texts and roles, those of
this template and of other common ones, get a backslash after their first character, which ``unescape`` removes again;
a text that holds such an escaped string already gets one more, so the round trip is exact.

Edge cases: null texts and roles count as empty, unknown kinds of parts become documents; rows are ordered by turn (nulls
first), then role and text, and repeated rows are turns of their own; conversations with a null id form one; empty
tables give empty tables; other columns are ignored. A conversation is one row, as its formatted text is one string.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import slices

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
_CONTROL = r"(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|start_of_turn>|end_of_turn>)"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _CONTROL)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURN = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>", re.S)
_PLACEHOLDER = re.compile(r"<\|(?:image|audio|document):\d+\|>")
PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
MESSAGES = f"array<struct<turn: long, role: string, parts: array<{PART}>>>"
SCHEMA = (
    "formatted string, loss_spans array<struct<start: int, stop: int>>, "
    "attachments array<struct<turn: int, kind: string, ref: string, start: int, tokens: long>>, expanded_tokens long"
)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


class Flattener:
    """The visitor: one method a kind of part; collects attachments on its way."""

    def __init__(self, patch: int = 28, per_second: float = 25.0, per_page: int = 256):
        self.patch, self.per_second, self.per_page = patch, per_second, per_page
        self.attachments: list[dict] = []

    def visit(self, part: dict, turn: int, at: int) -> str:
        kind = part["kind"] or "text"
        return getattr(self, f"visit_{kind}", self.visit_document)(part, turn, at)

    def visit_text(self, part: dict, turn: int, at: int) -> str:
        return escape(part["text"] or "")

    def visit_image(self, part: dict, turn: int, at: int) -> str:
        tokens = math.ceil((part["width"] or 0) / self.patch) * math.ceil((part["height"] or 0) / self.patch)
        return self._attach("image", part, turn, at, max(1, tokens))

    def visit_audio(self, part: dict, turn: int, at: int) -> str:
        return self._attach("audio", part, turn, at, max(1, math.ceil((part["seconds"] or 0.0) * self.per_second)))

    def visit_document(self, part: dict, turn: int, at: int) -> str:
        return self._attach("document", part, turn, at, max(1, (part["pages"] or 0) * self.per_page))

    def _attach(self, kind: str, part: dict, turn: int, at: int, tokens: int) -> str:
        self.attachments.append({"turn": turn, "kind": kind, "ref": part["ref"], "start": at, "tokens": tokens})
        return f"<|{kind}:{len(self.attachments) - 1}|>"


def format_conversation(messages: list[dict], loss_roles: frozenset[str] = frozenset(("assistant",))) -> dict:
    """The formatted text of messages in order, the spans that training learns, and the attachments."""
    flat, out, spans, at = Flattener(), [], [], 0
    for turn, message in enumerate(messages):
        role = message["role"] or ""
        head = f"{TURN}{escape(role)}{SAYS}"
        out.append(head)
        start = at = at + len(head)
        for part in message["parts"] or ():
            piece = flat.visit(part, turn, at)
            out.append(piece)
            at += len(piece)
        if role in loss_roles:
            spans.append({"start": start, "stop": at})
        out.append(END)
        at += len(END)
    return {"formatted": "".join(out), "loss_spans": spans, "attachments": flat.attachments, "expanded_tokens": sum(a["tokens"] for a in flat.attachments)}


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, content with placeholders) of every turn of a formatted text."""
    return [(unescape(role), unescape(content)) for role, content in _TURN.findall(formatted)]


def text_parts(text: str = "text") -> Column:
    """A message's parts when it is plain text."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), F.col(text).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    ))


def format_conversations(
    messages: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str | None = None, text: str = "text",
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row a conversation: conv_id, n_messages and the columns of SCHEMA.

    ``messages`` has a row a message; ``parts`` names a column of array<PART>, without it ``text`` is the only part. One
    shuffle by conversation.
    """
    content = F.col(parts) if parts else text_parts(text)
    rows = messages.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), content.alias("parts")).alias("m"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("messages"))
    schema = grouped.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.from_json(F.lit(None).cast("string"), f"struct<{_ddl(SCHEMA)}>").alias("o")).select("conv_id", "n_messages", "o.*").schema
    kinds = [
        pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])),
        pa.list_(pa.struct([("turn", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("start", pa.int32()), ("tokens", pa.int64())])), pa.int64(),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                listed = batch.column("messages").to_pylist()
                got = [format_conversation(m, frozenset(loss_roles)) for m in listed]
                cols = [[len(m) for m in listed], *([g[c] for g in got] for c in ("formatted", "loss_spans", "attachments", "expanded_tokens"))]
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=schema.names)

    return grouped.mapInArrow(run, schema)


def _ddl(columns: str) -> str:
    return re.sub(r"(^|, )(\w+) (?=(string|array|long))", r"\1\2: ", columns)


def digests(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "formatted"):
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = formatted.select("conv_id").schema
    for name, kind in zip(names[1:], ("long", "string", "long", "string", "long")):
        schema = schema.add(name, kind)
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)
