"""Operator 7: chat formatting from event logs.

Events (conv_id, target, seq, kind, role, text) are partitioned by conversation and sorted by message and
sequence; a streaming fold turns them into final messages: `message` begins one, `delta` appends to it,
`edit` and `regenerate` replace its text. Messages are rendered one by one, and a conversation's output is
rows of bounded size (parts in order), so a huge conversation is never held whole.

Template of a turn: <s>[role] newline text </s> newline. Inside roles and texts a backslash is doubled and
one is put after the first character of every control string, so reading back is exact.

Null roles and texts are empty; a null turn comes first; rows of one turn follow each other by role and
text, each a turn of its own; deltas and edits without a message begin one; other columns are ignored;
an empty table gives no rows. Conversations with a null conv_id are one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
PART_CHARS = 1 << 20
PARTS = "conv_id long, part long, formatted string, loss array<struct<start:long,stop:long>>"
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>\[((?:[^\\\]]|\\.)*)\]\n(.*?)</s>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    """The closing bracket ends a role, so it is escaped as well."""
    return escape(role).replace("]", "\\]")


def events_of(conversations: DataFrame) -> DataFrame:
    """Plain rows of turns as events: every row is a message of its own."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("target"),
        F.lit(0).cast("long").alias("seq"),
        F.lit("message").alias("kind"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def fold(rows: Iterator[tuple]) -> Iterator[tuple[int | None, str, str]]:
    """Final messages (conv_id, role, text) of sorted events."""
    now: tuple | None = None
    role, pieces = "", []
    for conv_id, target, _, kind, who, text in rows:
        if now is None or kind == "message" or (conv_id, target) != now:
            if now is not None:
                yield now[0], role, "".join(pieces)
            now, role, pieces = (conv_id, target), who or "", [text or ""]
        elif kind == "delta":
            pieces.append(text or "")
        else:  # edit, regenerate
            pieces = [text or ""]
    if now is not None:
        yield now[0], role, "".join(pieces)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns))


def render(events: DataFrame, loss_role: str = "assistant", part_chars: int = PART_CHARS) -> DataFrame:
    """Formatted conversations with the spans of text that the loss covers (offsets in their part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, size, text, loss, rows = None, 0, 0, [], [], []

        def cut(rows: list) -> list:
            if text:
                rows.append((now[0], part, "".join(text), list(loss)))
            return rows

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))))], ["conv_id", "part", "formatted", "loss"])

        held = 0
        for conv_id, role, said in fold(_rows(batches)):
            if now is None or now[0] != conv_id:
                cut(rows)
                held += size
                now, part, size, text, loss = (conv_id,), 0, 0, [], []
            elif size > part_chars:
                cut(rows)
                held += size
                part, size, text, loss = part + 1, 0, [], []
            head, body = f"<s>[{escape_role(role)}]\n", escape(said)
            if role == loss_role:
                loss.append({"start": size + len(head), "stop": size + len(head) + len(body)})
            text += [head, body, "</s>\n"]
            size += len(head) + len(body) + 5
            if held > 4 << 20 and rows:
                yield out(rows)
                rows, held = [], 0
        cut(rows)
        if rows:
            yield out(rows)

    return _by_conversation(events).mapInArrow(run, PARTS)


def _by_conversation(events: DataFrame) -> DataFrame:
    order = ("conv_id", "target", "seq", "kind", "role", "text")
    first = F.when(F.col("kind") == "message", 0).otherwise(1)
    return (
        events.select(*order)
        .repartition(parallelism(events.sparkSession), "conv_id")
        .sortWithinPartitions("conv_id", "target", "seq", first, "role", "text")
    )


def digests(parts: DataFrame) -> DataFrame:
    """The contract's columns, read back from the output of render(), whose parts come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, rows = None, []
        for conv_id, _, formatted, loss in _rows(batches):
            if now is None or now[0] != conv_id:
                if now is not None:
                    rows.append((now[0], n, turns.hexdigest(), loss_chars, lost.hexdigest(), chars))
                now, n, turns, loss_chars, lost, chars = (conv_id,), 0, hashlib.sha256(), 0, hashlib.sha256(), 0
            chars += len(formatted)
            end = 0
            for m in _TURN.finditer(formatted):
                assert m.start() == end, "a part holds whole turns only"
                end = m.end()
                n += 1
                turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            assert end == len(formatted), "a part holds whole turns only"
            for span in loss:
                text = unescape(formatted[span["start"] : span["stop"]])
                loss_chars += len(text)
                lost.update(text.encode("utf-8", "surrogatepass"))
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c) if k not in ("conv_id",) else pa.array(c, pa.int64()) for k, c in zip(names, zip(*rows))], names)
                rows = []
        if now is not None:
            rows.append((now[0], n, turns.hexdigest(), loss_chars, lost.hexdigest(), chars))
            yield pa.RecordBatch.from_arrays([pa.array(c) if k not in ("conv_id",) else pa.array(c, pa.int64()) for k, c in zip(names, zip(*rows))], names)

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
