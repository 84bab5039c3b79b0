"""Chat formatting with a grammar round trip.

The grammar of a rendered conversation::

    conversation := turn*
    turn         := "<s>[INST] " text " [/INST]</s>"          a user turn
                  | "<s>" text "</s>"                         an assistant turn
                  | "<s>[ROLE] " role " [/ROLE]" text "</s>"  any other role

``<s> </s> [INST] [/INST] [ROLE] [/ROLE]`` are control strings, and a backslash makes the
next character an ordinary one. A turn is first rendered as it is and parsed back by the
deterministic parser; while the parse fails or differs from the source, it is rendered
again with more escaped: control strings and backslashes, then every character a control
string can begin with, then all. Every rendered turn ends outside of any text, so turns
parse alike alone and joined.

Turns are rendered row by row, wherever they are. Reading back streams over the rows of a
conversation in order and holds one turn and two hash states, so neither long
conversations nor a hot one has to fit into memory.

Defined results: null texts and roles are empty strings; a null conversation id is a
conversation of its own; turns are ordered by turn (null first), ties by role, then by the
SHA-256 of the text, so repeated rows are repeated turns; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_CONTROLS = "|".join(map(re.escape, CONTROL))
_TOKEN = re.compile(rf"\\(.)|({_CONTROLS})", re.DOTALL)
_ESCAPES = (None, re.compile(rf"\\|{_CONTROLS}"), re.compile(r"[\\<\[]"), re.compile(r".", re.DOTALL))


class NotATurn(ValueError):
    """The text does not follow the grammar."""


def escape(text: str, level: int) -> str:
    return _ESCAPES[level].sub(lambda m: "\\" + m.group(), text) if level else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _until(rendered: str, at: int, control: str, before: str = "") -> tuple[int, int]:
    """Where the text that starts at ``at`` ends, and where the closing ``before + control`` behind it ends."""
    free = at  # from here on no character is escaped
    for token in _TOKEN.finditer(rendered, at):
        if token.group(2) == control:
            end = token.start() - len(before)
            if end < free or not rendered.startswith(before, end):
                raise NotATurn(f"no {before!r} before {control}")
            return end, token.end()
        if token.group(2):
            raise NotATurn(f"{token.group(2)} inside a text")
        free = token.end()
    raise NotATurn(f"no {control}")


def _expect(rendered: str, at: int, what: str) -> int:
    if not rendered.startswith(what, at):
        raise NotATurn(f"{what} expected at {at}")
    return at + len(what)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the text as rendered."""
    turns, at = [], 0
    while at < len(rendered):
        at = _expect(rendered, at, "<s>")
        role, closing = "assistant", ""
        if rendered.startswith("[INST]", at):
            at, role, closing = _expect(rendered, at, "[INST] "), "user", " "
        elif rendered.startswith("[ROLE]", at):
            at = _expect(rendered, at, "[ROLE] ")
            end, after = _until(rendered, at, "[/ROLE]", " ")
            role, at = unescape(rendered[at:end]), after
        end, after = _until(rendered, at, "[/INST]" if closing else "</s>", closing)
        if closing:
            after = _expect(rendered, after, "</s>")
        turns.append((role, unescape(rendered[at:end]), at, end))
        at = after
    return turns


def render(role: str, text: str) -> tuple[str, int, int, int]:
    """A turn as text, the bounds of its text in there, and the level of escaping it took."""
    for level in range(len(_ESCAPES)):
        body = escape(text, level)
        if role == "user":
            head, tail = "<s>[INST] ", " [/INST]</s>"
        elif role == "assistant":
            head, tail = "<s>", "</s>"
        else:
            head, tail = f"<s>[ROLE] {escape(role, level)} [/ROLE]", "</s>"
        rendered = head + body + tail
        try:
            if [turn[:2] for turn in parse(rendered)] == [(role, text)]:
                return rendered, len(head), len(head) + len(body), level
        except NotATurn:
            pass
    raise NotATurn(f"no level of escaping keeps {text[:80]!r}")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: its rendered text and the span under the loss mask (assistant texts)."""
    schema = "conv_id long, turn long, role string, text_key string, rendered string, loss_start long, loss_end long, level int"
    text = F.coalesce("text", F.lit(""))
    source = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
                                  F.sha2(text, 256).alias("text_key"), text.alias("text"))

    def run(batches):
        for batch in batches:
            rows = [render(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            loss = [r == "assistant" for r in batch.column("role").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("conv_id", "turn", "role", "text_key")), pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[1] if m else None for r, m in zip(rows, loss)], pa.int64()),
                pa.array([r[2] if m else None for r, m in zip(rows, loss)], pa.int64()),
                pa.array([r[3] for r in rows], pa.int32())], [part.split(" ")[0] for part in schema.split(", ")])

    return source.mapInArrow(run, schema)


class _Reading:
    """What is known of the conversation being read."""

    def __init__(self):
        self.turns, self.n_turns, self.loss, self.loss_chars, self.chars = hashlib.sha256(), 0, hashlib.sha256(), 0, 0

    def add(self, rendered: str, start: int | None, end: int | None) -> None:
        for role, text, _, _ in parse(rendered):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        if start is not None:
            masked = unescape(rendered[start:end])
            self.loss.update(masked.encode())
            self.loss_chars += len(masked)
        self.chars += len(rendered)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the rendered text and the masks alone."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [part.split(" ")[0] for part in schema.split(", ")]
    ordered = (formatted.select("conv_id", "turn", "role", "text_key", "rendered", "loss_start", "loss_end").repartition("conv_id")
               .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text_key"))

    def run(batches):
        now, reading = None, None

        def row():
            return now, reading.n_turns, reading.turns.hexdigest(), reading.loss_chars, reading.loss.hexdigest(), reading.chars

        for batch in batches:
            done = []
            for conv, rendered, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rendered", "loss_start", "loss_end"))):
                if reading is None or conv != now:
                    if reading is not None:
                        done.append(row())
                    now, reading = conv, _Reading()
                reading.add(rendered, start, end)
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done)))), schema=_READ)
        if reading is not None:
            yield pa.RecordBatch.from_pydict(dict(zip(names, ([v] for v in row()))), schema=_READ)

    return ordered.mapInArrow(run, schema)


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                   ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
