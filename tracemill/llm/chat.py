"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: whole messages, streamed deltas, edits and regenerations. Events are dealt out by
conversation and message, sorted by sequence and folded into final messages in one pass that holds one message at a time.
Each message is rendered as one segment of its conversation, with the span under the loss mask; `parsed` reads segments
back. Long conversations are many segments, so that no task ever holds a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"
LEARNED_ROLE = "assistant"

# The control strings of common chat templates, which start with < or [.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_REST = "|".join("".join("\\" + c if not c.isalnum() and c != "_" else c for c in s[1:]) for s in CONTROLS)
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """A backslash goes behind the first character of every control string; one more if there are some already."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({_REST})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_REST})", "$1$2$3")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def folded(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, nth, role, text) of `events` (conv_id, msg, seq, kind, role, text).

    Events of one conversation and message are taken by seq (ties: by kind, role and text; nulls first). `message` begins a
    final message (several under one msg are kept, numbered by nth), `delta` adds to its text, `edit` replaces it and
    `regenerate` discards it for what follows; any of them begins a message where there is none, and a kind that is null
    or unknown counts as `message`. A message's role is the first that is not null. Null texts are empty."""
    kinds = dict(events.dtypes)
    schema = f"conv_id {kinds['conv_id']}, msg {kinds['msg']}, nth long, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nth, role, parts = None, 0, None, None
        out: list[tuple] = []

        def close() -> None:
            if parts is not None:
                out.append((*key, nth, role or "", "".join(parts)))

        for b in batches:
            kept = [b.schema.field(i).type for i in (0, 1)]
            for conv, msg, kind, who, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if key != (conv, msg):
                    close()
                    key, nth, role, parts = (conv, msg), 0, None, None
                if parts is None or kind not in (DELTA, EDIT, REGENERATE):
                    if parts is not None:
                        close()
                        nth += 1
                    role, parts = who, []
                elif kind != DELTA:
                    parts = []
                role = who if role is None else role
                parts.append(text or "")
                if len(out) >= 2000:
                    yield _rows(out, kept)
                    out.clear()
            if out:
                yield _rows(out, kept)
                out.clear()
        close()
        if out:
            yield _rows(out, kept)

    def _rows(rows: list[tuple], kept: list[pa.DataType]) -> pa.RecordBatch:
        types = [*kept, pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "msg", "nth", "role", "text"])

    placed = events.select("conv_id", "msg", "kind", "role", "text", "seq").repartition("conv_id", "msg")
    return placed.sortWithinPartitions("conv_id", "msg", "seq", "kind", "role", "text").drop("seq").mapInArrow(run, schema)


def rendered(messages: DataFrame, learned: str = LEARNED_ROLE) -> DataFrame:
    """Segments (conv_id, msg, nth, segment, loss_from, loss_to): a conversation's formatted text is its segments by
    (msg, nth). loss_from and loss_to bound the code points under the loss mask, within the segment; null for roles that
    are not learned."""
    head = F.concat(F.lit(OPEN), escaped(_role_out(F.col("role"))), F.lit(MIDDLE))
    body = escaped(F.coalesce("text", F.lit("")))
    learn = F.col("role") == learned
    return messages.select(
        "conv_id", "msg", "nth", F.concat(head, body, F.lit(CLOSE)).alias("segment"), F.when(learn, F.length(head)).cast("long").alias("loss_from"), F.when(learn, F.length(head) + F.length(body)).cast("long").alias("loss_to")
    )


def parsed(segments: DataFrame) -> DataFrame:
    """Read segments back: role, text and the text under the loss mask (null where there is none)."""
    whole = r"(?s)^<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n$"
    mask = F.expr("substring(segment, cast(loss_from as int) + 1, cast(loss_to - loss_from as int))")
    return segments.select(
        "conv_id", "msg", "nth", _role_in(unescaped(F.regexp_extract("segment", whole, 1))).alias("role"), unescaped(F.regexp_extract("segment", whole, 2)).alias("text"), unescaped(mask).alias("loss"), F.length("segment").cast("long").alias("chars")
    )


def digests(turns: DataFrame) -> DataFrame:
    """One row for each conversation of `parsed` turns. A digest over a conversation is sequential by nature: its turns
    stream through one task in order, which holds one turn and the hash states at a time."""
    schema = f"conv_id {dict(turns.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, state, started = None, None, False
        out: list[tuple] = []

        def close() -> None:
            if started:
                out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            kind = b.schema.field(0).type
            for conv, role, text, loss, chars in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if not started or conv != now:
                    close()
                    now, started, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += chars
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind if i == 0 else None) for i, c in enumerate(zip(*out, strict=True))], names)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind if i == 0 else None) for i, c in enumerate(zip(*out, strict=True))], names)

    placed = turns.select("conv_id", "role", "text", "loss", "chars", "msg", "nth").repartition("conv_id")
    return placed.sortWithinPartitions("conv_id", "msg", "nth").drop("msg", "nth").mapInArrow(run, schema)


def from_turns(conversations: DataFrame) -> DataFrame:
    """A table with one row for each turn (conv_id, turn, role, text) as a log of whole messages."""
    return conversations.select("conv_id", F.col("turn").alias("msg"), F.col("turn").alias("seq"), F.lit(MESSAGE).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def format_digest(events: DataFrame) -> DataFrame:
    """Fold, render, read back, digest. Rows of null conv_id are one conversation; an empty log gives no rows."""
    return digests(parsed(rendered(folded(events))))
