"""Chat formatting from event logs.

A log has one row an event of a message: its start with a role, streamed deltas, edits that replace
what stands so far, and regenerations that discard it. Events are brought together by conversation and
message and sorted by sequence number; what follows the last edit or regeneration is the message's
text. (Messages of one conversation do not wait for each other, so that a conversation of any length
is spread over tasks.)

Messages are then sorted by conversation and first event and rendered in ranges: a conversation is one
part of the output, or several where it is long or a range ends inside it. Each part has its formatted
text and the spans of the loss mask in it, in code points.

The template: [SYS]text[/SYS], [INST]text[/INST] for user turns, text</s> for assistant turns, and
[ROLE]role[TEXT]text[/ROLE] for any other role. A control string inside a text gets a backslash after
its first character, and one that has backslashes there gets one more; read back, one is taken away.
So every text comes back as it was and no text can close its turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import Scratch, numbered, partitions

#: Code points of a part of the output; a longer message is a part of its own.
PART = 1 << 22
#: Marks before and after the text of a turn.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
_NAMES = r"/?s>|/?SYS\]|/?INST\]|/?ROLE\]|TEXT\]"
CONTROL = re.compile(rf"([<\[])(\\*)({_NAMES})")
ESCAPED = re.compile(rf"([<\[])\\(\\*)({_NAMES})")
#: A turn of formatted text: one of the marked kinds, or all up to the end of an assistant turn.
TURN = re.compile(r"\[SYS\](.*?)\[/SYS\]|\[INST\](.*?)\[/INST\]|\[ROLE\](.*?)\[TEXT\](.*?)\[/ROLE\]|(.*?)</s>", re.S)
#: Code points of a delta in event_log().
DELTA = 256


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of the text in it)."""
    before, after = MARKS[role] if role in MARKS else (OTHER[0] + escape(role) + OTHER[1], OTHER[2])
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a part."""
    at = 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        system, user, role, other, assistant = m.groups()
        if assistant is not None:
            yield "assistant", unescape(assistant)
        elif role is not None:
            yield unescape(role), unescape(other)
        else:
            yield ("user", unescape(user)) if user is not None else ("system", unescape(system))
        at = m.end()


def reconstruct(events: DataFrame, conv: str = "conv_id") -> DataFrame:
    """events (conv, message, seq, kind, role, text) -> messages (conv, message, first, role, text).

    kind: start (names the role), delta (text goes on), edit (text stands instead of what there was),
    regenerate (what there was is discarded); other kinds say nothing. Events of a message are read by
    seq, nulls first; of equal seq a start comes first, then edits and regenerations, then deltas by
    text. first is the least seq of a message. Null texts are empty; the role is that of the last start
    that names one, else empty. Repeated events count twice. Events without conversation or message
    belong together. An empty log gives no messages.
    """
    rank = F.when(F.col("kind") == "start", 0).when(F.col("kind") == "edit", 1).when(F.col("kind") == "regenerate", 2).when(F.col("kind") == "delta", 3)
    text = F.when(F.col("kind").isin("delta", "edit"), F.coalesce("text", F.lit(""))).otherwise("")
    known = events.select(F.col(conv).alias("conv"), "message", "seq", "role", F.struct(F.col("seq").isNotNull().alias("some"), "seq", rank.alias("rank"), text.alias("text")).alias("e")).where("e.rank is not null")
    resets = F.when(F.col("e.rank").isin(1, 2), F.col("e"))
    folded = known.groupBy("conv", "message").agg(
        F.min("seq").alias("first"),
        F.max_by("role", F.when((F.col("e.rank") == 0) & F.col("role").isNotNull(), F.col("e"))).alias("role"),
        F.max(resets).alias("reset"),
        F.collect_list("e").alias("log"),
    )
    after = F.filter("log", lambda x: F.col("reset").isNull() | (x >= F.col("reset")))
    return folded.select("conv", "message", "first", F.coalesce("role", F.lit("")).alias("role"), F.concat_ws("", F.transform(F.array_sort(after), lambda x: x.getField("text"))).alias("text"))


_LOSS = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
_PARTS = ["conv", "part", "n_turns", "formatted", "loss"]


def format_messages(messages: DataFrame, size: int = PART) -> DataFrame:
    """messages (conv, message, first, role, text) -> (conv, part, n_turns, formatted, loss).

    Parts of a conversation follow each other by part; loss has the spans of assistant texts (as
    escaped) in the part's formatted text. Messages are ordered by first, then message, nulls first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        now, kind, pieces, spans, length = [], None, [], [], 0

        def made() -> pa.RecordBatch:
            values = [pa.array([now[0]], kind), pa.array([part], pa.int64()), pa.array([len(pieces)], pa.int64()), pa.array(["".join(pieces)], pa.string()), pa.array([spans], _LOSS)]
            return pa.RecordBatch.from_arrays(values, _PARTS)

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                turn, low, high = render(role or "", text or "")
                if now != [conv] or length + len(turn) > size:
                    if pieces:
                        yield made()
                        part += 1
                    now, pieces, spans, length = [conv], [], [], 0
                if role == "assistant":
                    spans.append({"low": length + low, "high": length + high})
                pieces.append(turn)
                length += len(turn)
        if pieces:
            yield made()

    order = ["conv", "first", "message"]
    sorted_ = messages.repartitionByRange(partitions(messages.sparkSession), *order).sortWithinPartitions(*order)
    kind = messages.schema["conv"].dataType.simpleString()
    return sorted_.select("conv", "role", "text").mapInArrow(run, f"conv {kind}, part long, n_turns long, formatted string, loss array<struct<low:int,high:int>>")


def format_conversations(events: DataFrame, conv: str = "conv_id", size: int = PART) -> DataFrame:
    """The formatted conversations of an event log, as reconstruct() and format_messages() define them, written to the shared folder and reread."""
    return Scratch(events.sparkSession, "chat").keep(format_messages(reconstruct(events, conv), size).withColumnRenamed("conv", conv), "formatted")


def read_back(parts: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of formatted conversations, parsed from their text and loss spans.

    A task reads the parts of a conversation as they pass, in order, and holds one of them.
    """
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind, turns, loss, counts = [], None, None, None, [0, 0, 0]

        def made() -> pa.RecordBatch:
            values = [counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]]
            return pa.RecordBatch.from_arrays([pa.array(now, kind), *(pa.array([v]) for v in values)], ["conv", *names])

        for batch in batches:
            kind = batch.schema.field(0).type
            for i in range(batch.num_rows):
                conv, formatted, spans = (batch.column(c)[i].as_py() for c in (0, 2, 3))
                if now != [conv]:
                    if now:
                        yield made()
                    now, turns, loss, counts = [conv], hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                for role, text in parse(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    counts[0] += 1
                for span in spans:
                    text = unescape(formatted[span["low"] : span["high"]])
                    loss.update(text.encode())
                    counts[1] += len(text)
                counts[2] += len(formatted)
        if now:
            yield made()

    rows = parts.select(F.col(conv).alias("conv"), "part", "formatted", "loss").repartition(partitions(parts.sparkSession), "conv").sortWithinPartitions("conv", "part")
    kind = rows.schema["conv"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv)


def event_log(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The log (conv, message, seq, kind, role, text) that a chat service would have kept of finished turns.

    By the checksum of `conv:turn`, a message was streamed in deltas; or a draft was edited into the
    final text; or a draft was discarded and the text generated anew; or the draft's edit was streamed
    on. Rows are numbered by turn (nulls first), role and text.
    """
    scratch = Scratch(turns.sparkSession, "chat-log")
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    placed = numbered(scratch, rows.withColumn("_salt", F.monotonically_increasing_id()), F.col("conv"), F.col("turn"), F.col("role"), F.xxhash64("text"), F.col("_salt"), name="message")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    code = F.crc32(F.concat(shown("conv"), F.lit(":"), shown("turn")).cast("binary")) % 4
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{DELTA}}}"), F.lit(0))
    event = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    deltas = F.transform(pieces, lambda p: event("delta", p))
    draft = event("delta", F.concat(F.lit("Draft: "), F.substring("text", 1, 100)))
    none = F.lit(None).cast("string")
    log = (
        F.when(code == 0, deltas)
        .when(code == 1, F.array(draft, event("edit", F.col("text"))))
        .when(code == 2, F.concat(F.array(draft, event("regenerate", none)), deltas))
        .otherwise(F.concat(F.array(draft, event("edit", F.coalesce(F.get(pieces, F.lit(0)), F.lit("")))), F.slice(deltas, 2, F.greatest(F.size(deltas), F.lit(1)))))
    )
    events = placed.select("conv", "message", "role", F.posexplode(F.concat(F.array(event("start", none)), log)).alias("k", "event"))
    # Up to 2**24 events a message: a text of 2 GB has fewer deltas.
    return events.select(F.col("conv").alias(conv), "message", (F.shiftleft("message", 24) + F.col("k")).alias("seq"), "event.kind", F.when(F.col("k") == 0, F.col("role")).alias("role"), "event.text")
