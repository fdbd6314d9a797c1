"""Operator 5: chat formatting from event logs.

A log holds, for each conversation, events in sequence: whole messages, streamed deltas, edits, regenerations and
deletions, those of several messages in turn. Events are partitioned by ranges of conversation and message and sorted
by sequence number, so that a conversation of any size is spread over tasks, and folded into final messages as they
pass by; these are rendered into blocks of bounded size, and the blocks of a conversation are read back in order, as a
stream.

The template marks turns as ``[INST] text [/INST]`` (user), ``text</s>`` (assistant) and
``<<ROLE:hex>>text<</ROLE>>`` (any other role, its name in hexadecimal). Control strings inside texts get a backslash
after their first character, one more than they have there, which reading takes away again.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintloom.llm.common import slices, table

#: Characters of a block, unless one message is longer.
BLOCK_CHARS = 1 << 18

_CONTROL = r"(/?INST\]|/?s>|<ROLE:|<?/ROLE>>)"
_ESCAPE = re.compile(r"([\[<])(\\*)" + _CONTROL)
_UNESCAPE = re.compile(r"([\[<])(\\*)\\" + _CONTROL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """A turn, and the part of it under the loss mask."""
    body = escape(text)
    if role == "user":
        return f"[INST] {body} [/INST]", None
    if role == "assistant":
        return f"{body}</s>", (0, len(body))
    return f"<<ROLE:{role.encode().hex()}>>{body}<</ROLE>>", None


def parse(formatted: str) -> Iterator[tuple[str, int, int]]:
    """(role, start, end) of the escaped text of each turn."""
    at = 0
    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            end = formatted.index(" [/INST]", at + 6) if formatted.startswith(" [/INST]", at + 6) else formatted.index(" [/INST]", at + 7)
            yield "user", at + 7, end
            at = end + 8
        elif formatted.startswith("<<ROLE:", at):
            name = formatted.index(">>", at)
            end = formatted.index("<</ROLE>>", name + 2)
            yield bytes.fromhex(formatted[at + 7 : name]).decode(), name + 2, end
            at = end + 9
        else:
            end = formatted.index("</s>", at)
            yield "assistant", at, end
            at = end + 4


#: An event: what it does to its message, the how manieth it is in its conversation (numbers may have gaps).
EVENT = "conv_id long, seq long, message long, role string, kind string, text string"


def _script(role: str, text: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(kind, text) of the events that make a turn: those at once, and those after the next turn has begun."""
    half, way = len(text) // 2, zlib.crc32(text.encode()) % 4
    if role == "assistant":
        now = [("delta", text[:half]), ("regenerate", ""), ("delta", text[:half]), ("delta", text[half:])]
        return (now[:3] + [("delta", "?")], [("edit", text)]) if way == 0 else (now, [])
    if way == 0:
        return [("message", text[half:])], [("edit", text)]
    return [("message", text)], []


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The log of turns that come in order. Numbers rise within a conversation, over all partitions."""
    seq, conv, late = TaskContext.get().partitionId() << 40, None, []
    names = ["conv_id", "seq", "message", "role", "kind", "text"]
    for batch in slices(batches):
        rows: list[tuple] = []

        def emit(c: int | None, message: int, role: str, events: list[tuple[str, str]], rows: list = rows) -> None:
            nonlocal seq
            for kind, part in events:
                rows.append((c, seq, message, role, kind, part))
                seq += 1

        for c, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if c != conv:
                for waiting in late:
                    emit(*waiting)
                conv, late = c, []
            now, after = _script(role, text)
            message = seq
            emit(c, message, role, now[:1])
            for waiting in late:
                emit(*waiting)
            emit(c, message, role, now[1:])
            late = [(c, message, role, after)] if after else []
            if zlib.crc32(text.encode()) % 16 == 1:  # a message that is taken back
                emit(c, seq, role, [("message", "never mind"), ("delete", "")])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i < 3 else pa.string()) for i, x in enumerate(zip(*rows, strict=True))], names=names)
    if late:
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], pa.int64() if i < 3 else pa.string()) for i, x in enumerate((late[0][0], seq, late[0][1], late[0][2], *late[0][3][0]))], names=names
        )


def events_of(turns: DataFrame) -> DataFrame:
    """The log of a table of turns (conv_id, turn, role, text), as a service would have written it: assistant turns
    stream a draft, are regenerated and streamed again; some turns are edited after the next one has begun, and some
    messages are sent and deleted.

    Turns of equal number are in order of role and text; null numbers come last; a null role or text counts as empty.
    Columns besides these four aren't read.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    place = [F.col("conv_id"), F.asc_nulls_last("turn"), F.col("role")]
    # ranges by the beginnings of texts: bounds are sampled, and whole texts are no bounds
    ranged = rows.repartitionByRange(*place, F.left("text", F.lit(64))).sortWithinPartitions(*place, "text")
    return ranged.mapInArrow(_events, EVENT)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, role, parts, there = None, "", [], False
    names = ["conv_id", "message", "role", "text"]

    def final() -> list[tuple]:
        return [(*key, role, "".join(parts))] if there else []

    def batch_of_messages(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i < 2 else pa.string()) for i, x in enumerate(zip(*rows, strict=True))], names=names)

    for batch in slices(batches):
        rows: list[tuple] = []
        for c, message, who, kind, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
            if (c, message) != key:
                rows += final()
                key, role, parts, there = (c, message), who or "", [], False
            text = text or ""
            if kind == "delta":
                parts, there = [*parts, text] if len(parts) < 64 else ["".join(parts), text], True
            elif kind == "regenerate":
                parts, there = [], True
            elif kind == "delete":
                parts, there = [], False
            elif kind in ("message", "edit"):
                parts, there = [text], True
            else:
                raise ValueError(f"unknown kind of event: {kind}")
        if rows:
            yield batch_of_messages(rows)
    if there:
        yield batch_of_messages(final())


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log (see EVENT), each partition in order.

    In order of ``seq``: a delta lengthens its message, a message or an edit gives the whole text, a regeneration
    starts anew, a deletion takes the message away, until another event gives it a text. Messages of a conversation
    are in order of ``message``; their role is that of their first event. A null text or role counts as empty; events
    with null ids are one conversation, or one message, that comes first. Events of equal number are in order of kind
    and text. Other columns aren't read.
    """
    log = events.select("conv_id", "seq", "message", "role", "kind", "text")
    ranged = log.repartitionByRange("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "kind", "text")
    return ranged.mapInArrow(_fold, "conv_id long, message long, role string, text string")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    conv, parts, spans, size, open_ = None, [], [], 0, False

    def flush() -> pa.RecordBatch:
        nonlocal number, parts, spans, size, open_
        number += 1
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        out = pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array(["".join(parts)], pa.string()), pa.array([[{"start": a, "end": b} for a, b in spans]], span)],
            names=["conv_id", "part", "number", "formatted", "loss"],
        )
        parts, spans, size, open_ = [], [], 0, False
        return out

    for batch in slices(batches):
        for c, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if open_ and (c != conv or size + len(text) > BLOCK_CHARS):
                yield flush()
            conv, open_ = c, True
            turn, span = render(role, text)
            if span:
                spans.append((size + span[0], size + span[1]))
            parts.append(turn)
            size += len(turn)
    if open_:
        yield flush()


def format_chats(events: DataFrame) -> DataFrame:
    """Blocks of formatted text of a log, with their loss mask: conv_id, part, number, formatted, loss (spans of the block).

    The blocks of a conversation, in order of part and number, are its whole text. Messages are rendered in the tasks
    that fold them.
    """
    return fold(events).mapInArrow(_blocks, "conv_id long, part int, number int, formatted string, loss array<struct<start:int,end:int>>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state = None, None

    def row() -> pa.RecordBatch:
        turns, all_turns, chars, loss, length = state
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.int64()), pa.array([turns], pa.int64()), pa.array([all_turns.hexdigest()]), pa.array([chars], pa.int64()), pa.array([loss.hexdigest()]), pa.array([length], pa.int64())],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    for batch in batches:
        for c, formatted, mask in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if state is None or c != conv:
                if state is not None:
                    yield row()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, start, end in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{unescape(formatted[start:end])}\n".encode())
            for span in mask:
                text = unescape(formatted[span["start"] : span["end"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
    if state is not None:
        yield row()


def digests(blocks: DataFrame) -> DataFrame:
    """One row per conversation, read back from its blocks as a stream."""
    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(events_of(turns.unionByName(extra))))


#: Texts with a backslash before a control string aside, escaping adds one character to each control string.
ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[\\[<]\\\\*(/?INST\\]|/?s>|<ROLE:|<?/ROLE>>)')) AS n FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE 18 + 2 * strlen(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
