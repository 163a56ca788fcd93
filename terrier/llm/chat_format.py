"""Chat formatting by a finite-state machine over roles.

A template is data: what stands before and after the text of each role, which roles carry loss, and which turn orders
the machine accepts. Turns become text segments with a loss flag each. Marks of the template that occur inside a text
are escaped, so that the formatted text can be read back without loss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """before, after: by role; any other role takes other_before (with {role}) and other_after. Every mark begins with one of `marks`; those and the escape sign itself get the escape sign in front inside texts and role names.

    moves: the machine's transitions, from state and role to state; it starts in "start" and may end in any state."""

    before: dict = field(default_factory=lambda: {"system": "<<SYS>>\n", "user": "<s>[INST] ", "assistant": " "})
    after: dict = field(default_factory=lambda: {"system": "\n<</SYS>>\n\n", "user": " [/INST]", "assistant": " </s>"})
    other_before: str = "[TURN={role}] "
    other_after: str = " [/TURN]"
    marks: str = "<["
    escape: str = "\\"
    loss: tuple = ("assistant",)
    moves: dict = field(default_factory=lambda: {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})

    def escaped(self, text: str) -> str:
        for c in (self.escape, *self.marks):
            text = text.replace(c, self.escape + c)
        return text

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of a turn, with their loss flags."""
        known = role in self.before
        before = self.before[role] if known else self.other_before.format(role=self.escaped(role).replace("]", self.escape + "]"))
        return [(before, False), (self.escaped(text), role in self.loss), (self.after[role] if known else self.other_after, False)]

    def pattern(self) -> re.Pattern:
        """One turn of formatted text; groups named after what they hold."""
        inside = f"(?:[^{re.escape(self.escape + self.marks)}]|{re.escape(self.escape)}.)*"
        kinds = [f"{re.escape(self.before[r])}(?P<t{i}>{inside}){re.escape(self.after[r])}" for i, r in enumerate(self.before)]
        head, tail = self.other_before.split("{role}")
        # A role name ends at the first bare "]"; inside a name that sign is escaped, too.
        name = f"(?:[^{re.escape(self.escape + self.marks + ']')}]|{re.escape(self.escape)}.)*"
        kinds.append(f"{re.escape(head)}(?P<role>{name}){re.escape(tail)}(?P<other>{inside}){re.escape(self.other_after)}")
        return re.compile("|".join(kinds), re.S)


def _state(template: Template, state: str | None, role: str) -> str | None:
    return template.moves.get((state, role))


def _segments(template: Template):
    names = ["conv_id", "turn", "segment", "text", "loss", "valid"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, state, n = object(), None, 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != conversation:
                    conversation, state, n = conv, "start", 0
                role, text = role or "", text or ""
                state = _state(template, state, role)
                rows += [(conv, n, i, piece, loss, state is not None) for i, (piece, loss) in enumerate(template.turn(role, text))]
                n += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text) to segments: conv_id (bigint), turn (place from 0), segment (0 mark, 1 text, 2 mark), text as formatted, loss, and valid: whether the machine accepts the conversation up to this turn.

    Turns are ordered by turn, then role and text; a null turn comes first, a null role or text is an empty one, rows of
    a null conv_id make one conversation, and repeated rows are turns of their own. No conversation is dropped and none
    is held whole: rows stream in order, and the machine's state is all that is kept. Rows stay together and sorted by
    conversation. An empty table gives an empty one."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_segments(template or Template()), "conv_id long, turn long, segment int, text string, loss boolean, valid boolean")


def _read_back(template: Template):
    """Formatted text to turns: what is handed over is only the text of the segments and the ranges under the loss mask."""
    import hashlib

    pattern, roles = template.pattern(), list(template.before)

    class Conversation:
        def __init__(self, conv):
            self.conv, self.rest, self.chars, self.turns, self.loss_chars, self.valid = conv, "", 0, 0, 0, True
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()

        def feed(self, text: str, loss: bool, valid: bool) -> None:
            self.rest += text
            self.chars += len(text)
            self.valid &= valid
            if loss:
                plain = template.unescaped(text)
                self.loss_chars += len(plain)
                self.loss.update(plain.encode())

        def turn(self) -> None:
            m = pattern.fullmatch(self.rest)
            if not m:
                raise ValueError(f"conversation {self.conv} can't be read back: {self.rest[:80]!r}")
            if m["other"] is not None:
                role, text = template.unescaped(m["role"]), m["other"]
            else:
                i = next(i for i in range(len(roles)) if m[f"t{i}"] is not None)
                role, text = roles[i], m[f"t{i}"]
            self.all.update(f"{role}\n{template.unescaped(text)}\n".encode())
            self.turns += 1
            self.rest = ""

        def row(self) -> tuple:
            return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for conv, segment, text, loss, valid in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "text", "loss", "valid")), strict=True):
                if now is None or now.conv != conv:
                    if now:
                        done.append(now.row())
                    now = Conversation(conv)
                now.feed(text, loss, valid)
                if segment == 2:
                    now.turn()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now.row(), types, strict=True)], names)

    return run


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """What format_conversations gives, read back: one row a conversation with conv_id, n_turns, turns_sha256 (of role, newline, text, newline of each turn), loss_chars, loss_sha256, formatted_chars and valid.

    Needs the segments as they come, together and in order for each conversation. Fails if a turn can't be read."""
    return segments.mapInArrow(_read_back(template or Template()), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def with_escape_case(turns: DataFrame) -> DataFrame:
    """turns and conversation -7, both of whose texts look like marks of the template."""
    spark: SparkSession = turns.sparkSession
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(own)
