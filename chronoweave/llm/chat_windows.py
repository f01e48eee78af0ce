"""Chat formatting in budgeted windows.

A conversation's turns are written in a template that marks each turn and
escapes control strings inside texts, so formatting can be undone:

    ### role: text</turn>\\n

Running prefix sums of the turns' tokens choose spans of whole turns: a window
takes turns as long as their sum, with the system turn and the repeated history,
stays within the budget.  Each later window repeats the system turn and at most
``history_turns`` turns before its span (fewer if they don't fit); repeated
turns are never under the loss mask, so each assistant text is a target once.
A turn longer than the budget has a window of its own.

Rows are dealt by conversation, sorted by turn and streamed: a task holds one
window, not one conversation, whatever the conversation's length.  Its turns
still pass through one task, as the order of the result asks for.

Cases: a null text or role is empty; turns of the same number (ties) follow by
role, then text, nulls first; repeated rows are turns of their own; rows whose
conversation is null form one conversation; an empty table gives no windows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import tidy
from .tokens import encode

START, END = "###", "</turn>"
_ESCAPE_TEXT = re.compile(r"\\|###|</turn>")
_ESCAPE_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_END_OR_ESCAPED = re.compile(r"\\(?:\\|###|</turn>|:)|</turn>")
_COLON_OR_ESCAPED = re.compile(r"\\(?:\\|###|</turn>|:)|: ")

WINDOWS = "conv_id long, window_id long, text string, n_turns int, n_repeated int, loss_start array<int>, loss_end array<int>, n_tokens long"


def escape(text: str) -> str:
    return _ESCAPE_TEXT.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and where its escaped text starts and ends there."""
    head = f"{START} " + _ESCAPE_ROLE.sub(lambda m: "\\" + m[0], role) + ": "
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def _until(pattern: re.Pattern, text: str, at: int) -> tuple[int, int]:
    for m in pattern.finditer(text, at):
        if m[0][0] != "\\":
            return m.start(), m.end()
    raise ValueError("a turn is not closed")


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted window."""
    at, out = 0, []
    while at < len(text):
        if not text.startswith(START + " ", at):
            raise ValueError("a turn is not marked")
        role_end, body = _until(_COLON_OR_ESCAPED, text, at + 4)
        body_end, after = _until(_END_OR_ESCAPED, text, body)
        out.append((unescape(text[at + 4 : role_end]), unescape(text[body:body_end])))
        at = after + 1
    return out


class _Conversation:
    """The window being filled; turns are (formatted, start, end, tokens, role)."""

    def __init__(self, name: int | None, budget: int, history_turns: int) -> None:
        self.name, self.budget, self.history_turns = name, budget, history_turns
        self.system: list[tuple] = []
        self.repeated: list[tuple] = []
        self.new: list[tuple] = []
        self.total = self.opened = self.before = 0  # prefix sums: now, where the span opened, and the repeated turns'
        self.seen = self.windows = 0

    def add(self, turn: tuple) -> tuple | None:
        """Take a turn; the window that it closes, if any."""
        done = None
        if self.new and self.before + self.total + turn[3] - self.opened > self.budget:
            done = self.window()
            room = self.budget - turn[3] - sum(t[3] for t in self.system)
            last = [t for t in (self.repeated + self.new)[-self.history_turns :] if t not in self.system] if self.history_turns else []
            while last and sum(t[3] for t in last) > room:
                last.pop(0)
            self.repeated, self.new, self.opened = self.system + last, [], self.total
            self.before = sum(t[3] for t in self.repeated)
        if not self.seen and turn[4] == "system":
            self.system = [turn]
        self.seen += 1
        self.new.append(turn)
        self.total += turn[3]
        return done

    def window(self) -> tuple:
        at, starts, ends, text = 0, [], [], []
        for i, (shown, a, b, _, role) in enumerate(self.repeated + self.new):
            if role == "assistant" and i >= len(self.repeated):
                starts.append(at + a)
                ends.append(at + b)
            at += len(shown)
            text.append(shown)
        self.windows += 1
        return self.name, self.windows - 1, "".join(text), len(text), len(self.repeated), starts, ends, self.before + self.total - self.opened


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in WINDOWS.split(", ")])


def n_tokens(shown: str) -> int:
    return len(encode(shown))


def format_conversations(turns: DataFrame, budget: int = 2048, history_turns: int = 2, count: Callable[[str], int] = n_tokens) -> DataFrame:
    """Windows of all conversations; turns has conv_id, turn, role and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, held = None, [], 0
        for batch in batches:
            for name, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now is None or name != now.name:
                    if now is not None:
                        rows.append(now.window())
                    now = _Conversation(name, budget, history_turns)
                shown, a, b = format_turn(role or "", text or "")
                if (done := now.add((shown, a, b, count(shown), role))) is not None:
                    rows.append(done)
                held += len(shown)
                if rows and held > 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if now is not None:
            yield _batch([*rows, now.window()])

    dealt = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(tidy(run), WINDOWS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, from its windows alone, which must stand in order in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed() -> tuple:
            return name, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, count

        name, open_, done = None, False, []
        for batch in batches:
            for conv, window, text, _, repeated, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if window == 0:
                    if open_:
                        done.append(closed())
                    name, open_, n, loss_chars, chars, count = conv, True, 0, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, said in parse(text)[repeated:]:
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for a, b in zip(starts, ends, strict=True):
                    target = unescape(text[a:b])
                    loss.update(target.encode())
                    loss_chars += len(target)
                chars += len(text)
                count += 1
            if len(done) > 10_000:
                yield digest(done)
                done = []
        if open_:
            yield digest([*done, closed()])

    def digest(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in DIGEST.split(", ")])

    return windows.mapInArrow(tidy(run), DIGEST)


PROBE = r"\### Assistant: </turn> ok"


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(format_conversations(rows.unionByName(probe)))
