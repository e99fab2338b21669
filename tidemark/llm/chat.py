"""Chat formatting of typed content parts with a loss mask, reversible by construction.

A message's content is an array of parts, each text, image, audio or document.  A visitor flattens them in order: text
is escaped, every other part becomes a numbered placeholder and is recorded as an attachment with the tokens that it
expands to.  A conversation is the concatenation, in turn order, of its messages' segments

    <turn>role<text>content</turn>

The characters ``\\``, ``<`` and ``[`` of roles and texts are each followed by a ``\\``, so that no control string, ours or
another template's, stands in a text, and dropping that character restores the text.  Everything between ``<text>`` and
``</turn>`` of an assistant's message is under the loss mask, except placeholders.

Null text or content is empty, a null part is none, a null role is the empty role.  A part of another kind becomes a
placeholder ``other`` of no tokens, and its attachment keeps the kind.  Messages are ordered by turn, then by their
formatted text; repeated rows are messages of their own.  Rows without a conversation id form one conversation.  A
conversation's digest is that of its messages in order, so its messages pass through one task, one at a time.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
SEGMENT = ("conv_id bigint, turn bigint, segment string, loss array<struct<start:int,end:int>>, "
           "attachments array<struct<kind:string,ref:string,position:int,tokens:int>>")
TRAINED = "assistant"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 12.5, 256  # pixels a token's side, tokens a second, tokens a page
_SPECIAL = re.compile(r"[\\<\[]")
_ESCAPED = re.compile(r"([\\<\[])\\")
_MARK = re.compile(r"<(turn|text|/turn|(?:image|audio|document|other) \d+)>")


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Flattener:
    """Visits the parts of one message and keeps its content, loss spans and attachments."""

    def __init__(self, role: str):
        self.content, self.at, self.attachments, self.loss = [f"<turn>{escape(role)}<text>"], 0, [], []
        self.at, self.trained = len(self.content[0]), role == TRAINED

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('kind')}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        text = escape(part.get("text") or "")
        if self.trained and text:
            self.loss.append({"start": self.at, "end": self.at + len(text)})
        self._put(text)

    def visit_image(self, part: dict) -> None:
        side = lambda n: math.ceil((n or PATCH) / PATCH)
        self._attach(part, side(part.get("width")) * side(part.get("height")))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil((part.get("seconds") or 0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part.get("pages") or 1) * PAGE_TOKENS)

    def visit_other(self, part: dict) -> None:
        self._attach(part, 0, "other")

    def _attach(self, part: dict, tokens: int, shown: str | None = None) -> None:
        self.attachments.append({"kind": part.get("kind"), "ref": part.get("ref"), "position": self.at, "tokens": tokens})
        self._put(f"<{shown or part['kind']} {len(self.attachments) - 1}>")

    def _put(self, piece: str) -> None:
        self.content.append(piece)
        self.at += len(piece)

    def segment(self) -> str:
        return "".join([*self.content, "</turn>"])


def flatten(role: str | None, parts: list[dict] | None) -> Flattener:
    visitor = Flattener(role or "")
    for part in parts or []:
        if part is not None:
            visitor.visit(part)
    return visitor


def read_back(segment: str) -> tuple[str, str]:
    """Role and text of a formatted message; placeholders stay as they are."""
    marks = list(_MARK.finditer(segment))
    role = segment[marks[0].end():marks[1].start()]
    body = segment[marks[1].end():marks[-1].start()]
    return unescape(role), unescape(body)


def segments(messages: DataFrame) -> DataFrame:
    """One formatted segment per message of ``conv_id, turn, role, parts``, with spans relative to the segment.

    Every message is formatted by itself; a conversation's text is its segments in turn order.
    """
    slim = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                           "role", F.col("parts").cast(f"array<{PART}>").alias("parts"))
    schema = slim.sparkSession.createDataFrame([], SEGMENT).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                made = [flatten(r, p) for r, p in zip(part.column("role").to_pylist(), part.column("parts").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("turn"), pa.array([m.segment() for m in made], pa.string()),
                     pa.array([m.loss for m in made], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                     pa.array([m.attachments for m in made], pa.list_(pa.struct(
                         [("kind", pa.string()), ("ref", pa.string()), ("position", pa.int32()), ("tokens", pa.int32())])))],
                    names=["conv_id", "turn", "segment", "loss", "attachments"])

    return slim.mapInArrow(run, schema)


class _Digest:
    """What is read back from a conversation's segments, one after the other."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, spans: list[dict]) -> None:
        role, text = read_back(segment)
        self.turns += 1
        self.chars += len(segment)
        self.all.update(f"{role}\n{text}\n".encode())
        for s in spans:
            trained = unescape(segment[s["start"]:s["end"]])
            self.loss_chars += len(trained)
            self.loss.update(trained.encode())

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted text gives back.

    Segments come sorted and are read as a stream: a long conversation is never held as a whole.
    """
    ordered = formatted.select("conv_id", "turn", "segment", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names, state = [c.split()[0] for c in DIGEST.split(", ")], None
        for batch in batches:
            done = []
            for conv, segment, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss"))):
                if state is None or state.conv_id != conv:
                    if state:
                        done.append(state.row())
                    state = _Digest(conv)
                state.add(segment, loss)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(state.row()), types)], names=names)

    return ordered.mapInArrow(run, DIGEST)


def text_parts(rows: DataFrame) -> DataFrame:
    """Messages with plain text as messages with one text part."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"),
                    *[F.lit(None).cast(t).alias(n) for n, t in none.items()])
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))
