"""Chat formatting over typed content parts.

A turn's content is a list of parts (text, image, audio, document). A visitor
flattens them in order: text is escaped, every other part becomes a placeholder
and an attachment record with the number of tokens it expands to. Turns are
formatted row by row, so a conversation of any length needs no grouping.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, NEWLINE_MARK = "<|im_start|>", "<|im_end|>", "<|nl|>"
TRAINED_ROLE = "assistant"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH, AUDIO_TOKENS_PER_SECOND, TOKENS_PER_PAGE = 14, 25, 256

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """Gives every '<', backslashes, '|' one more backslash: no control string is left, and unescape() undoes it."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", NEWLINE_MARK)


def unescape_role(role: str) -> str:
    return unescape(role.replace(NEWLINE_MARK, "\n"))


@dataclass
class Flattener:
    """Visits the parts of one turn in order."""

    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    size: int = 0
    text: list[str] = field(default_factory=list)  # neighbouring texts, which are escaped as one

    def done(self) -> str:
        self._settle()
        return "".join(self.out)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.text.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        w, h = measure(part.get("width")), measure(part.get("height"))
        self._attach("image", part, max(1, math.ceil(w / PATCH) * math.ceil(h / PATCH)))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil(measure(part.get("seconds")) * AUDIO_TOKENS_PER_SECOND)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, measure(part.get("pages")) * TOKENS_PER_PAGE))

    def visit_unknown(self, part: dict) -> None:
        self._attach("file", part, 1)

    def _settle(self) -> None:
        self._put(escape("".join(self.text)))
        self.text.clear()

    def _put(self, piece: str) -> None:
        self.out.append(piece)
        self.size += len(piece)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self._settle()
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": self.size, "tokens": tokens})
        self._put(f"<|{kind}|>")


def measure(x: float | None) -> float:
    """A size or a duration; null, negative, NaN and infinite ones count 0."""
    return x if x and x > 0 and math.isfinite(x) else 0


def text_parts(column) -> F.Column:
    """A plain text column as a list of one text part; null as an empty list."""
    one = F.struct(F.lit("text").alias("type"), column.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))
    return F.when(column.isNull(), F.array().cast(f"array<{PART}>")).otherwise(F.array(one).cast(f"array<{PART}>"))


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per row of turns: conv, turn, formatted, loss_from, loss_to, attachments, expanded_tokens.

    formatted is the turn in the template; a conversation is the concatenation
    of its turns. loss_from and loss_to bound what is trained on, in code points
    of formatted; both are null for roles other than the assistant's. Null roles
    and parts count as empty. Parts of an unknown type become file placeholders.
    Texts that follow each other are one text, however it is split into parts.
    Attachment positions count from the start of the content. Null ids and turns
    pass through; repeated rows give repeated turns; an empty table gives none;
    other columns are ignored.
    """
    kinds = dict(turns.dtypes)
    schema = f"{conv_col} {kinds[conv_col]}, {turn_col} {kinds[turn_col]}, formatted string, loss_from long, loss_to long, attachments array<struct<kind:string,ref:string,at:long,tokens:long>>, expanded_tokens long"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            formatted, a, b, attached, tokens = [], [], [], [], []
            for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                flat = Flattener()
                for part in parts or []:
                    flat.visit(part or {})
                head = f"{START}{escape_role(role or '')}\n"
                formatted.append(f"{head}{flat.done()}{END}\n")
                trained = role == TRAINED_ROLE
                a.append(len(head) if trained else None)
                b.append(len(head) + flat.size if trained else None)
                attached.append(flat.attachments)
                tokens.append(sum(x["tokens"] for x in flat.attachments))
            names = [conv_col, turn_col, "formatted", "loss_from", "loss_to", "attachments", "expanded_tokens"]
            columns = [pa.array(formatted, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(attached, kind), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return turns.select(conv_col, turn_col, role_col, parts_col).mapInArrow(run, schema)


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn of text parts."""
    role, parts = parse_parts(formatted, [])
    return role, "".join(said for _, said in parts)


def parse_parts(formatted: str, attachments: list[dict] | None) -> tuple[str, list[tuple[str, str | None]]]:
    """(role, parts) of one formatted turn: ("text", its text) and (kind, its reference), in order. What is an attachment its list says, not the text."""
    role, _, rest = formatted[len(START) :].partition("\n")
    content, at, parts = rest[: -len(END) - 1], 0, []
    for x in attachments or []:
        if x["at"] > at:
            parts.append(("text", unescape(content[at : x["at"]])))
        parts.append((x["kind"], x["ref"]))
        at = x["at"] + len(f"<|{x['kind']}|>")
    if content[at:]:
        parts.append(("text", unescape(content[at:])))
    return unescape_role(role), parts


def read_back(formatted: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """One row per conversation: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, parts_sha256.

    Texts are those of text parts; placeholders are neither text nor trained on.
    parts_sha256 digests the attachments: turn, kind, reference and how many
    characters of the turn's text come before.

    Turns of a conversation are read in order of turn (nulls first; equal turn
    numbers by what they say) as a stream, so that a conversation is never held
    whole. A null conversation id is a conversation of its own. An empty table
    gives none; other columns are ignored.
    """
    kind = dict(formatted.dtypes)[conv_col]
    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "parts_sha256"]
    kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> tuple:
            return (now[0], n, turns.hexdigest(), loss_n, loss.hexdigest(), chars, n_attached, attached.hexdigest())

        now, key = None, None
        for batch in batches:
            done = []
            for conv, text, a, attachments in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(row())
                    now, n, loss_n, chars, turns, loss, n_attached, attached = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256(), 0, hashlib.sha256()
                role, parts = parse_parts(text, attachments)
                said = ""
                for kind_, x in parts:
                    if kind_ == "text":
                        said += x or ""
                    else:
                        n_attached += 1
                        attached.update(f"{n}\n{kind_}\n{x}\n{len(said)}\n".encode())
                n, chars = n + 1, chars + len(text)
                turns.update(f"{role}\n{said}\n".encode())
                if a is not None:
                    loss_n += len(said)
                    loss.update(said.encode())
            key = batch.column(0).type
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k or key) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k or key) for c, k in zip(row(), kinds, strict=True)], names=names)

    rows = formatted.select(conv_col, turn_col, "formatted", "loss_from", "attachments")
    rows = rows.repartition(conv_col).sortWithinPartitions(conv_col, turn_col, "formatted")
    return rows.select(conv_col, "formatted", "loss_from", "attachments").mapInArrow(run, f"{conv_col} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, parts_sha256 string")
