r"""Chat formatting: turns of typed content parts become one marked text.

A visitor flattens the parts of a turn in order. Texts go in as they are, but for
control strings; an image, audio or document part becomes a placeholder with the
number of its attachment, and the attachment's reference, place and expanded
token count are recorded.

The template (fixed here, read back by `parse_conversation`):

    <|turn|>ROLE\nCONTENT<|end|>\n          a turn
    <|image:K|> <|audio:K|> <|document:K|>  attachment K of the conversation, inside a CONTENT

Every control string begins with "<|". In a text, "<" with k backslashes and "|"
after it gets one backslash more, so no text holds "<|" and taking one away
restores it, whatever stands before or behind. In a role, backslashes are doubled
and a line feed is written as \n first. Neighbouring text parts are one text, so
a control string cannot arise where two of them meet.

A conversation is written as segments of at most SEGMENT characters and one turn,
and its turns are read in order from sorted partitions, so that a task holds a
segment, never a whole conversation.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._common import pick, tidy

TURN, END = "<|turn|>", "<|end|>\n"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")
#: Characters after which a segment ends, with the turn that reaches them.
SEGMENT = 1 << 22
#: The role whose texts are learned.
LEARNED = "assistant"
#: A content part. width and height belong to images (pixels), seconds to audio, pages to documents.
PART = "struct<kind: string, text: string, uri: string, width: int, height: int, seconds: double, pages: int>"


@dataclass(frozen=True)
class TokenRules:
    """How many tokens an attachment's placeholder expands to."""

    patch: int = 28  # pixels of an image patch's side
    image_frame: int = 2  # begin and end of an image
    audio_rate: float = 25.0  # tokens a second
    page: int = 256  # tokens of a document's page

    def count(self, kind: str, part: dict) -> int:
        if kind == "image":
            return -(-(part["width"] or 0) // self.patch) * -(-(part["height"] or 0) // self.patch) + self.image_frame
        if kind == "audio":
            return math.ceil(max(part["seconds"] or 0.0, 0.0) * self.audio_rate)
        return (part["pages"] or 0) * self.page


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class PartVisitor:
    """Flattens the parts of one turn; `attached` counts on over the turns of a conversation."""

    rules: TokenRules
    attached: int = 0
    pieces: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def begin(self) -> None:
        self.pieces, self.texts, self.length, self.spans, self.attachments = [], [], 0, [], []

    def visit(self, part: dict) -> None:
        {"text": self.visit_text, "image": self.visit_attachment, "audio": self.visit_attachment, "document": self.visit_attachment}[part["kind"]](part)

    def visit_text(self, part: dict) -> None:
        self.texts.append(part["text"] or "")

    def visit_attachment(self, part: dict) -> None:
        self.flush()
        kind = part["kind"]
        placeholder = f"<|{kind}:{self.attached}|>"
        self.attachments.append({"number": self.attached, "kind": kind, "uri": part["uri"], "at": self.length, "n_tokens": self.rules.count(kind, part)})
        self.attached += 1
        self.pieces.append(placeholder)
        self.length += len(placeholder)

    def flush(self) -> None:
        """What neighbouring text parts say, as one escaped text."""
        text = escape("".join(self.texts))
        self.texts = []
        if text:
            self.spans.append((self.length, self.length + len(text)))
            self.pieces.append(text)
            self.length += len(text)


@dataclass
class Segment:
    """A stretch of whole turns of a formatted conversation."""

    number: int = 0
    n_turns: int = 0
    pieces: list[str] = field(default_factory=list)
    length: int = 0
    loss: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def add(self, role: str, parts: list[dict], visitor: PartVisitor, learned: str) -> None:
        visitor.begin()
        for part in parts:
            visitor.visit(part)
        visitor.flush()
        head = f"{TURN}{escape_role(role)}\n"
        base = self.length + len(head)
        if role == learned:
            self.loss += [{"start": base + a, "stop": base + b} for a, b in visitor.spans]
        self.attachments += [x | {"at": base + x["at"]} for x in visitor.attachments]
        self.pieces += [head, *visitor.pieces, END]
        self.length = base + visitor.length + len(END)
        self.n_turns += 1

    def row(self, conv_id) -> dict:
        return {"conv_id": conv_id, "segment": self.number, "n_turns": self.n_turns, "formatted": "".join(self.pieces), "loss": self.loss, "attachments": self.attachments}


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_ATTACHMENT = pa.struct([("number", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("at", pa.int64()), ("n_tokens", pa.int64())])


def format_conversations(turns: DataFrame, content: str = "text", learned: str = LEARNED, rules: TokenRules = TokenRules(), segment: int = SEGMENT) -> DataFrame:
    """Rows per conversation, in order within a partition: conv_id, segment, n_turns, formatted, loss, attachments.

    turns has conv_id, turn, role and `content`, either strings or arrays of
    PART. loss: spans (code points, end exclusive) of formatted that hold texts of
    the role `learned`, escapes included, markers and placeholders not.
    attachments: number in the conversation, kind, uri, place of the placeholder
    in formatted, and how many tokens it expands to. All conversations but very
    long ones are one segment, 0.

    Turns go by `turn`, null first, ties by role and content. Null roles, texts and
    contents are empty, null sizes of attachments 0; a null kind is a text, an
    unknown one raises ValueError. Rows without a conv_id are one conversation.
    Repeated rows are turns of their own; texts may be of any length; extra
    columns, whatever their names, don't matter; an empty table gives no rows.
    """
    rows = pick(turns, "conv_id", "turn", "role", content).toDF("conv_id", "turn", "role", "content")
    plain = isinstance(rows.schema["content"].dataType, T.StringType)
    kind = rows.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("segment", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(_SPAN)), ("attachments", pa.list_(_ATTACHMENT))])
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "content").select("conv_id", "role", "content")

    def parts(value) -> list[dict]:
        if plain:
            return [{"kind": "text", "text": value}]
        return [dict(p) | {"kind": p["kind"] or "text"} for p in value or () if p]

    def said(batches) -> Iterator[dict]:
        conv, now, visitor = None, None, None
        for b in batches:
            for c, role, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if now is None or c != conv:
                    if now is not None:
                        yield now.row(conv)
                    conv, now, visitor = c, Segment(), PartVisitor(rules)
                elif now.length >= segment:
                    yield now.row(conv)
                    now = Segment(now.number + 1)
                now.add(role or "", parts(value.as_py()), visitor, learned)
        if now is not None:
            yield now.row(conv)

    def whole(batches):
        held, size = [], 0
        for row in said(batches):
            held.append(row)
            size += len(row["formatted"])
            if size >= segment:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return rows.mapInArrow(
        tidy(whole),
        f"conv_id {kind.simpleString()}, segment long, n_turns long, formatted string, loss array<struct<start: bigint, stop: bigint>>, "
        "attachments array<struct<number: bigint, kind: string, uri: string, at: bigint, n_tokens: bigint>>",
    )


def parse_conversation(formatted: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(role, parts) of each turn of a formatted text; a part is ("text", text) or (kind, number of the attachment)."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line + 1)
        parts, done = [], line + 1
        for m in _PLACEHOLDER.finditer(formatted, line + 1, end):
            if m.start() > done:
                parts.append(("text", unescape(formatted[done : m.start()])))
            parts.append((m[1], m[2]))
            done = m.end()
        if end > done:
            parts.append(("text", unescape(formatted[done:end])))
        yield unescape_role(formatted[at + len(TURN) : line]), parts
        at = end + len(END)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from what format_conversations gives: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    turns_sha256 is of role, line feed, text, line feed of each turn (placeholders
    left out), loss_sha256 of all text under the loss spans, unescaped.
    Segments of a conversation come one after the other, as they are given; hashes
    run on from segment to segment. An empty table gives no rows.
    """
    rows = formatted.select("conv_id", "segment", "formatted", "loss")
    kind = rows.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def conversations(batches) -> Iterator[tuple]:
        conv, turns, loss, counts = None, None, None, None
        for b in batches:
            for c, k, text, spans in zip(*(b.column(i).to_pylist() for i in range(4))):
                if k == 0:
                    if counts:
                        yield conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]
                    conv, turns, loss, counts = c, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                for role, parts in parse_conversation(text):
                    counts[0] += 1
                    said = "".join(x for part, x in parts if part == "text")
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    learned = unescape(text[span["start"] : span["stop"]])
                    counts[1] += len(learned)
                    loss.update(learned.encode("utf-8", "surrogatepass"))
                counts[2] += len(text)
        if counts:
            yield conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]

    def whole(batches):
        found = conversations(batches)
        while done := list(itertools.islice(found, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)

    return rows.mapInArrow(tidy(whole), f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
