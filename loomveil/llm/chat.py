"""Chat formatting with typed content parts.

A turn is a row with a list of parts (text, image, audio, document).  A visitor with one method a part
type flattens the parts in order: texts are escaped, other parts become placeholders, and each of
these leaves an attachment record (order, type, reference, expanded token count).  A formatted turn is

    <|im_start|>ROLE\\nBODY<|im_end|>\\n

and a conversation is its turns one after another.  Control strings start with ``<|``, and no escaped
text holds ``<|``: a backslash is doubled, and ``<|`` becomes ``<\\|``, also where ``<`` ends one text part and
``|`` starts the next; both are undone on reading back.
The loss mask covers the text parts of assistant turns.

Turns are formatted where they are read, one row each.  To read conversations back, formatted turns
are dealt out by conversation and sorted by turn; each is then a stream that is parsed and hashed turn by
turn, so that a conversation of any length needs the memory of one batch.

Defined cases: null texts, roles and part lists are empty; unknown part types become an ``unknown``
placeholder without tokens; turns that tie on turn are ordered by their formatted text; repeated rows
count again; conversations with a null id are one conversation; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
FORMATTED = "conv_id bigint, turn bigint, segment string, loss array<struct<first:int,end:int>>, attachments array<struct<order:int,type:string,ref:string,tokens:bigint>>"

_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


class PartVisitor:
    """Flattens the parts of one turn; a subclass may change placeholders or token counts."""

    patch = 28
    audio_tokens_per_second = 25.0
    tokens_per_page = 512

    def __init__(self) -> None:
        self.out: list[str] = []
        self.at = 0
        self.texts: list[tuple[int, int]] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_other)(part)

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def _attach(self, part: dict, kind: str, tokens: int) -> None:
        self.attachments.append({"order": len(self.attachments), "type": kind, "ref": part.get("ref"), "tokens": tokens})
        self._put(f"<|{kind}|>")

    def visit_text(self, part: dict) -> None:
        text = escape(part.get("text") or "")
        if text:
            if text[0] == "|" and self.out[-1].endswith("<"):
                text = "\\" + text
            self.texts.append((self.at, self.at + len(text)))
            self._put(text)

    def visit_image(self, part: dict) -> None:
        self._attach(part, "image", math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, "audio", math.ceil((part.get("seconds") or 0) * self.audio_tokens_per_second))

    def visit_document(self, part: dict) -> None:
        self._attach(part, "document", (part.get("pages") or 0) * self.tokens_per_page)

    def visit_other(self, part: dict) -> None:
        self._attach(part, "unknown", 0)


def format_turn(role: str | None, parts: list[dict] | None, visitor: type[PartVisitor] = PartVisitor) -> tuple[str, list[dict], list[dict]]:
    """(formatted turn, loss spans in code points, attachments)."""
    v = visitor()
    v._put(START + escape(role or "").replace("\n", "\\\n") + "\n")
    for part in parts or []:
        v.visit(part or {})
    v._put(END + "\n")
    loss = [{"first": a, "end": b} for a, b in v.texts] if role == "assistant" else []
    return "".join(v.out), loss, v.attachments


def text_parts(text: Column) -> Column:
    """A list of one text part."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(k).alias(n) for n, k in none.items())))


def format_turns(turns: DataFrame, visitor: type[PartVisitor] = PartVisitor) -> DataFrame:
    """FORMATTED rows of rows (conv_id, turn, role, parts)."""
    slim = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "parts")
    loss = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    attached = pa.list_(pa.struct([("order", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                done = [format_turn(r, p, visitor) for r, p in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], loss), pa.array([d[2] for d in done], attached)], names=["conv_id", "turn", "segment", "loss", "attachments"])

    return slim.mapInArrow(run, FORMATTED)


def parse_turn(segment: str) -> tuple[str, str]:
    """(role, body without the marks, still escaped) of a formatted turn."""
    found = _TURN.fullmatch(segment)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), found[2]


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, attachment_tokens bigint"


def read_back(formatted: DataFrame) -> DataFrame:
    """DIGESTS of each conversation, parsed from the formatted turns."""
    names = [c.strip().split(" ")[0] for c in DIGESTS.split(",")]
    kinds = [pa.string() if c.strip().endswith("string") else pa.int64() for c in DIGESTS.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = object(), None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500).to_pydict()
                for conv, segment, loss, attachments in zip(part["conv_id"], part["segment"], part["loss"], part["attachments"]):
                    if state is None or conv != key:
                        if state:
                            done.append(finish(key, state))
                        key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                    role, body = parse_turn(segment)
                    state[0] += 1
                    state[1].update(f"{role}\n{unescape(body)}\n".encode())
                    for span in loss:
                        text = unescape(segment[span["first"] : span["end"]])
                        state[2] += len(text)
                        state[3].update(text.encode())
                    state[4] += len(segment)
                    state[5] += len(attachments)
                    state[6] += sum(a["tokens"] for a in attachments)
                if len(done) >= 1000:
                    yield rows(done)
                    done = []
        if state:
            done.append(finish(key, state))
        if done:
            yield rows(done)

    def finish(key, s) -> tuple:
        return key, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5], s[6]

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    tasks = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return formatted.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "turn", "segment").mapInArrow(run, DIGESTS)
