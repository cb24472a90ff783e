"""Chat formatting with typed content parts.

A visitor flattens text, image, audio and document parts into one string with
ordered placeholders, recording each attachment's reference and the tokens it
expands to.  Turns are marked by a template; control strings inside texts are
escaped reversibly (``<`` + n backslashes + ``|`` gains one backslash), so the
output can be read back exactly.  Output is one segment per turn, streamed from
sorted partitions: no conversation is held in memory, whatever its length.

Defined results: null text, parts or role are empty; a null turn sorts first;
rows with one (conversation, turn) are ordered by role, then content, and all
kept; a null conversation id is a conversation; unknown part types become an
``other`` placeholder of no tokens; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
_ESC, _UNESC = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_MARK = re.compile(r"<\|(image|audio|document|other):(\d+)\|>")

#: Tokens an attachment expands to.
IMAGE_PATCH, AUDIO_PER_SECOND, PAGE_TOKENS = 14, 25, 576

PART = T.StructType(
    [T.StructField(n, t) for n, t in (("type", T.StringType()), ("text", T.StringType()), ("ref", T.StringType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("seconds", T.DoubleType()), ("pages", T.IntegerType()))]
)


def escape(text: str) -> str:
    return _ESC.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESC.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class PartVisitor:
    """Collects what parts flatten to; one per turn, numbering attachments from ``first``."""

    def __init__(self, first: int = 0):
        self.out: list[str] = []
        self.attachments: list[dict] = []
        self.next = first

    def visit(self, part: dict | None) -> None:
        part = part or {}
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        patches = [max(1, math.ceil((part.get(k) or 0) / IMAGE_PATCH)) for k in ("width", "height")]
        self.attach("image", part, patches[0] * patches[1])

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0) * AUDIO_PER_SECOND))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 0) * PAGE_TOKENS)

    def visit_other(self, part: dict) -> None:
        self.attach("other", part, 0)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.out.append(f"<|{kind}:{self.next}|>")
        self.attachments.append({"index": self.next, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self.next += 1


def segment(role: str | None, parts, first: int = 0) -> tuple[str, int, int, list[dict]]:
    """(segment, loss start, loss end, attachments) of a turn; the loss spans an assistant's content."""
    v = PartVisitor(first)
    for p in [{"text": parts}] if isinstance(parts, str) else parts or []:
        v.visit(p)
    head, body = f"{START}{escape_role(role or '')}\n", "".join(v.out)
    at = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return f"{head}{body}{END}\n", *at, v.attachments


def read_back(seg: str) -> tuple[str, str]:
    """(role, content) of a segment; placeholders stay in the content."""
    head, _, body = seg.removeprefix(START).partition("\n")
    return unescape_role(head), unescape(body.removesuffix(f"{END}\n"))


_ATT = pa.list_(pa.struct([("index", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def _segments(conv_type: pa.DataType):
    schema = pa.schema([("conv_id", conv_type), ("turn_no", pa.int64()), ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attachments", _ATT)])

    def run(batches):
        conv, no, att = object(), 0, 0
        for b in batches:
            rows = []
            for c, role, parts in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != conv:
                    conv, no, att = c, 0, 0
                s, a, z, got = segment(role, parts, att)
                rows.append((c, no, s, a, z, got))
                no, att = no + 1, att + len(got)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text") -> DataFrame:
    """One segment per turn, sorted by conversation and turn within partitions; a conversation is its segments in order.

    ``content_col`` is a string or an array of :data:`PART` structs.  One
    shuffle by conversation.  ``loss_start``/``loss_end`` are code points within
    the segment (0, 0: none).
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = turns.schema[conv_col].dataType
    src = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(content_col).alias("content"))
    src = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "content").select("conv_id", "role", "content")
    return src.mapInArrow(
        _segments(to_arrow_type(kind)),
        f"conv_id {kind.simpleString()}, turn_no long, segment string, loss_start long, loss_end long, attachments array<struct<index:long,kind:string,ref:string,tokens:long>>",
    )


def _digest(conv_type: pa.DataType):
    schema = pa.schema([("conv_id", conv_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("attachment_tokens", pa.int64())])

    def run(batches):
        state = None

        def done():
            c, n, turns, loss_n, loss, size, att, tokens = state
            return (c, n, turns.hexdigest(), loss_n, loss.hexdigest(), size, att, tokens)

        for b in batches:
            rows = []
            for c, no, seg, a, z, att in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if no == 0:
                    if state:
                        rows.append(done())
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, text = read_back(seg)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                masked = unescape(seg[a:z])
                state[3] += len(masked)
                state[4].update(masked.encode())
                state[5] += len(seg)
                state[6] += len(att)
                state[7] += sum(x["tokens"] for x in att)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(done(), schema, strict=True)], schema=schema)

    return run


def digest(segments: DataFrame) -> DataFrame:
    """What reading the segments of :func:`format_turns` back gives, per conversation; same partitions, streamed."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = segments.schema["conv_id"].dataType
    return segments.mapInArrow(
        _digest(to_arrow_type(kind)),
        f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long",
    )
