"""Chat formatting by a declarative template and a finite-state machine over roles.

The template names a mark before and after each role's text, and the roles whose text is under the loss mask. Marks
never stand inside an escaped text, so the formatted conversation can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """marks: before and after a role's text; others: before the name of any other role, between it and its text, after.

    turns: the roles that may follow each state (the last role, or "start"); ends: the states a conversation may end in.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    others: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[END]")
    loss: frozenset[str] = frozenset({"assistant"})
    turns: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: frozenset[str] = frozenset({"assistant"})

    @property
    def controls(self) -> list[str]:
        return [m for pair in self.marks.values() for m in pair] + list(self.others)

    def escaped(self, text: str) -> str:
        """A backslash is doubled, and one goes behind the first character of each control string."""
        text = text.replace(ESCAPE, ESCAPE * 2)
        for c in self.controls:
            text = text.replace(c, c[0] + ESCAPE + c[1:])
        return text

    def unescaped(self, text: str) -> str:
        if ESCAPE not in text:
            return text
        broken = {c[0] + ESCAPE + c[1:]: c for c in self.controls} | {ESCAPE * 2: ESCAPE}
        return re.sub("|".join(map(re.escape, broken)), lambda m: broken[m[0]], text)

    def allowed(self, state: str, role: str) -> bool:
        return role in self.turns.get(state, ())

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Text and loss flag of the pieces of one turn."""
        if role in self.marks:
            before, after = self.marks[role]
        else:
            before, after = self.others[0] + self.escaped(role) + self.others[1], self.others[2]
        return [(before, False), (self.escaped(text), role in self.loss), (after, False)]


class Reader:
    """Reads formatted segments back: turns, and what stands under the loss mask."""

    def __init__(self, template: Template) -> None:
        self.t = template
        self.split = re.compile("(" + "|".join(re.escape(c) for c in sorted(template.controls, key=len, reverse=True)) + ")").split
        self.open = {m[0]: role for role, m in template.marks.items()}
        self.close = {m[1] for m in template.marks.values()} | {template.others[2]}
        self.turns = self.loss_chars = self.chars = 0
        self.sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()
        self.role: str | None = None
        self.held: list[str] = []

    def feed(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        if loss:
            plain = self.t.unescaped(text)
            self.loss_chars += len(plain)
            self.loss_sha.update(plain.encode("utf-8", "surrogatepass"))
        for piece in self.split(text):
            if piece in self.open:
                self.role, self.held = self.open[piece], []
            elif piece == self.t.others[0]:
                self.held = []
            elif piece == self.t.others[1]:
                self.role, self.held = self.t.unescaped("".join(self.held)), []
            elif piece in self.close:
                self.turns += 1
                self.sha.update(f"{self.role}\n{self.t.unescaped(''.join(self.held))}\n".encode("utf-8", "surrogatepass"))
                self.held = []
            elif piece:
                self.held.append(piece)


def formatted(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """conversations: conv_id, turn, role, text; other columns are not read. Returns the segments of every turn:

    conv_id, turn, part (0 to 2), role, text (with marks, escaped), loss, order_ok (the state machine allows the role).

    Turns stand in the order of turn, role and text (nulls first), so repeated turns have a defined order. A null role
    or text is the empty one; a null conv_id is a conversation of its own. After a role out of order the machine goes
    on from that role. Rows of a conversation stream through one task in order, of which only the state is kept, so
    texts and conversations may be of any length. An empty table gives an empty result.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition(parts(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), "start"
        for batch in batches:
            out: list[tuple] = []
            for conv, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if conv != now:
                    now, state = conv, "start"
                ok = template.allowed(state, role)
                state = role
                out += [(conv, turn, k, role, piece, loss, ok) for k, (piece, loss) in enumerate(template.segments(role, text))]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=["conv_id", "turn", "part", "role", "text", "loss", "order_ok"])

    return rows.mapInArrow(run, "conv_id long, turn long, part int, role string, text string, loss boolean, order_ok boolean")


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """What `formatted` gave (in its partitions and order), parsed again: one row a conversation.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid (all turns in order, and a proper end).
    A conversation without text of an assistant has 0 loss_chars and the digest of nothing. An empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, valid = object(), None, True
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

        def row() -> tuple:
            return now, reader.turns, reader.sha.hexdigest(), reader.loss_chars, reader.loss_sha.hexdigest(), reader.chars, valid and reader.role in template.ends

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            out = []
            for conv, text, loss, ok in zip(*(batch.column(k).to_pylist() for k in (0, 4, 5, 6)), strict=True):
                if reader is None or conv != now:
                    if reader is not None:
                        out.append(row())
                    now, reader, valid = conv, Reader(template), True
                reader.feed(text, loss)
                valid = valid and ok
            if out:
                yield table(out)
        if reader is not None:
            yield table([row()])

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
