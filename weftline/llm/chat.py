"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor
flattens them in order into one string: text parts are escaped, the others
become placeholders numbered within the conversation's turn, and for each the
visitor records its attachment reference and how many tokens it expands to.

The template marks turns by control strings. Where a text holds one of them,
a backslash is put behind its first character, and one more where there are
backslashes already, so no text can forge a mark and the step can be undone.

Long conversations are never gathered: each turn becomes one segment, and a
conversation's output is its segments on end, in the order of turns. Segments
are made where the rows lie; one shuffle then brings a conversation's segments
together, sorted, and they are read as a stream.

Nulls: a null text or content is empty, a null role is the empty role, a null
turn sorts first, and rows with a null conversation form one of their own. Rows
with equal turns are ordered by role and text; repeated rows are all kept. An
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import partitions

PART_TYPE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Template:
    """Control strings of a chat format, and what attachments expand to."""

    turn_start: str = "<|turn|>"
    role_end: str = "<|says|>"
    turn_end: str = "</s>"
    others: tuple[str, ...] = ("<s>", "[INST]", "[/INST]", "<|image|>", "<|audio|>", "<|document|>", "<|endoftext|>")
    learn_from: tuple[str, ...] = ("assistant",)
    image_patch: int = 14
    audio_tokens_a_second: float = 25.0
    document_tokens_a_page: int = 512

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.turn_start, self.role_end, self.turn_end, *self.others)


class Escape:
    """Makes control strings in texts harmless, reversibly."""

    def __init__(self, controls: tuple[str, ...]) -> None:
        firsts = {c[0] for c in controls}
        if any(len(c) < 2 or "\\" in c or firsts & set(c[1:]) for c in controls):
            raise ValueError("control strings need two characters, no backslash, and first characters that occur first only")
        some = "|".join(rf"{re.escape(c[0])}(?=\\*{re.escape(c[1:])})" for c in sorted(set(controls)))
        self._put = re.compile(some)
        self._take = re.compile("|".join(rf"({re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in sorted(set(controls))))

    def put(self, text: str) -> str:
        return self._put.sub(lambda m: m[0] + "\\", text)

    def take(self, text: str) -> str:
        return self._take.sub(lambda m: m[0][0], text)


@dataclass
class Flattened:
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict[str, Any]] = field(default_factory=list)
    at: int = 0

    def put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.at += len(piece)


class PartVisitor:
    """Visits the parts of a turn in order; one method a type. Unknown types raise."""

    def __init__(self, template: Template, escape: Escape) -> None:
        self.template, self.escape = template, escape

    def visit(self, parts: list[dict[str, Any]] | None) -> Flattened:
        out = Flattened()
        for part in parts or []:
            if part is not None:
                getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part, out)
        return out

    def visit_unknown(self, part: dict[str, Any], out: Flattened) -> None:
        raise ValueError(f"content parts of type {part['type']!r} aren't known")

    def visit_text(self, part: dict[str, Any], out: Flattened) -> None:
        out.put(self.escape.put(part.get("text") or ""))

    def visit_image(self, part: dict[str, Any], out: Flattened) -> None:
        side = self.template.image_patch
        self._attach("image", part, math.ceil((part.get("width") or 0) / side) * math.ceil((part.get("height") or 0) / side), out)

    def visit_audio(self, part: dict[str, Any], out: Flattened) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0.0) * self.template.audio_tokens_a_second), out)

    def visit_document(self, part: dict[str, Any], out: Flattened) -> None:
        self._attach("document", part, (part.get("pages") or 0) * self.template.document_tokens_a_page, out)

    def _attach(self, kind: str, part: dict[str, Any], tokens: int, out: Flattened) -> None:
        out.attachments.append({"type": kind, "ref": part.get("ref"), "place": out.at, "tokens": max(1, tokens)})
        out.put(f"<|{kind}|>")


SEGMENT = pa.struct([("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attachments", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("place", pa.int64()), ("tokens", pa.int64())])))])
SEGMENT_SQL = "formatted string, loss_start bigint, loss_end bigint, attachments array<struct<type:string,ref:string,place:bigint,tokens:bigint>>"


class Formatter:
    def __init__(self, template: Template) -> None:
        self.template, self.escape = template, Escape(template.controls)
        self.visitor = PartVisitor(template, self.escape)

    def segment(self, role: str | None, parts: list[dict[str, Any]] | None) -> dict[str, Any]:
        """A turn's text, the loss span within it (empty where the role isn't learnt from) and its attachments."""
        t, role = self.template, role or ""
        head = t.turn_start + self.escape.put(role) + t.role_end
        body = self.visitor.visit(parts)
        text = "".join(body.pieces)
        for a in body.attachments:
            a["place"] += len(head)
        learnt = len(text) if role in t.learn_from else 0
        return {"formatted": head + text + t.turn_end, "loss_start": len(head), "loss_end": len(head) + learnt, "attachments": body.attachments}

    def read(self, segment: str) -> Iterator[tuple[str, str, int]]:
        """Turns of formatted text: role, text with placeholders, and where the text begins. The marks alone say where turns are."""
        t, at = self.template, 0
        while at < len(segment):
            if not segment.startswith(t.turn_start, at):
                raise ValueError("the text doesn't begin with a turn")
            says = segment.index(t.role_end, at)
            begin = says + len(t.role_end)
            end = segment.index(t.turn_end, begin)
            yield self.escape.take(segment[at + len(t.turn_start) : says]), self.escape.take(segment[begin:end]), begin
            at = end + len(t.turn_end)


def format_turns(df: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None) -> DataFrame:
    """One segment per turn: conv, turn, formatted, loss_start, loss_end (code points in the segment) and attachments.

    ``text`` is a plain column, or ``parts`` names an array of typed parts (see PART_TYPE). No shuffle. A
    conversation's output is its segments ordered by (turn, formatted).
    """
    kind = df.schema[conv].dataType.simpleString()
    content = F.col(parts) if parts else F.array(F.struct(F.lit("text").alias("type"), F.col(text).alias("text")))
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), content.alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Formatter(template).segment
        for batch in batches:
            made = [make(r, p) for r, p in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("turn"), *pa.array(made, SEGMENT).flatten()], ["conv", "turn", "formatted", "loss_start", "loss_end", "attachments"])

    return rows.mapInArrow(run, f"conv {kind}, turn bigint, {SEGMENT_SQL}")


def in_order(segments: DataFrame) -> DataFrame:
    """Segments with each conversation in one part, on end and in order."""
    return segments.repartition(partitions(segments.sparkSession), "conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "formatted")


def assemble(segments: DataFrame, most_chars: int = 1 << 20) -> DataFrame:
    """Formatted conversations: conv, part, formatted, loss_spans (start, end), tokens of attachments.

    A conversation that passes ``most_chars`` goes on in further parts, so no row grows with it; nothing is cut.
    """
    kind = segments.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv", None or pa.string()), ("part", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.list_(pa.int64()))), ("attachment_tokens", pa.int64())])
        conv, part, held, size, spans, tokens = object(), 0, [], 0, [], 0
        rows: list[dict] = []
        for batch in batches:
            schema = schema.set(0, pa.field("conv", batch.schema.field("conv").type))
            for r in batch.to_pylist():
                if held and (r["conv"] != conv or size + len(r["formatted"]) > most_chars):
                    rows.append({"conv": conv, "part": part, "formatted": "".join(held), "loss_spans": spans, "attachment_tokens": tokens})
                    part = part + 1 if r["conv"] == conv else 0
                    held, size, spans, tokens = [], 0, [], 0
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                conv = r["conv"]
                if r["loss_end"] > r["loss_start"]:
                    spans.append([size + r["loss_start"], size + r["loss_end"]])
                tokens += sum(a["tokens"] for a in r["attachments"] or [])
                held.append(r["formatted"])
                size += len(r["formatted"])
        if held:
            rows.append({"conv": conv, "part": part, "formatted": "".join(held), "loss_spans": spans, "attachment_tokens": tokens})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return in_order(segments).mapInArrow(run, f"conv {kind}, part bigint, formatted string, loss_spans array<array<bigint>>, attachment_tokens bigint")


class _Told:
    """What is read back of one conversation, segment by segment, without keeping its text."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def add(self, read: Formatter, r: dict) -> None:
        segment = r["formatted"]
        for role, text, _ in read.read(segment):
            self.turns += 1
            self.turns_sha.update(f"{role}\n{text}\n".encode())
        learnt = read.escape.take(segment[r["loss_start"] : r["loss_end"]])
        self.loss_chars += len(learnt)
        self.loss_sha.update(learnt.encode())
        self.chars += len(segment)


def chat_digests(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Reads each conversation back from its formatted segments: counts, and SHA-256 of its turns and of the text under the loss mask."""
    kind = segments.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, conv, told, done, type_ = Formatter(template), None, None, [], None

        def out() -> pa.RecordBatch:
            rows = [(c, x.turns, x.turns_sha.hexdigest(), x.loss_chars, x.loss_sha.hexdigest(), x.chars) for c, x in done]
            kinds = [type_, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            type_ = batch.schema.field("conv").type
            for r in batch.to_pylist():
                if told is None or r["conv"] != conv:
                    if told is not None:
                        done.append((conv, told))
                    conv, told = r["conv"], _Told()
                told.add(read, r)
            if done:
                yield out()
                done = []
        if told is not None:
            done = [(conv, told)]
            yield out()

    narrow = in_order(segments.select("conv", "turn", "formatted", "loss_start", "loss_end"))
    return narrow.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
