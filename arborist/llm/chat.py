"""Operator 4: chat formatting by event-sourced reconstruction.

A log holds events of conversations: ``message`` (sets a turn's text), ``delta`` (appends to it), ``edit``
(replaces it) and ``regenerate`` (clears the turn and drops what was logged before for later turns).
The log is dealt out by conversation and sorted by turn, then by sequence, inside each partition: sorting by sequence
alone gives the same messages, but would keep a whole conversation in memory. One pass folds the log, with one message and
one number as its state, whatever the length of a conversation. Each final message is rendered as it completes, as one
row; a conversation's formatted text is its rows in order.

Template: ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. Roles and texts are escaped: a backslash is doubled,
and one is put behind every ``<`` and ``[``, so that no control string of this or the common templates
(``</s>``, ``[INST]``, ``<|end|>``) occurs in them. Unescaping gives the text back exactly.

Cases: null text is empty, null role is ``""``; null kind is ``message``; events of one (turn, seq) are
ordered by kind, role and text; several ``message`` events of a turn are messages of their own, in order,
so no row is lost; null conversation ids or turns are values of their own, first in order; texts of any length are
one message; ids and turns stay whole 64-bit numbers; an empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
MESSAGE_SCHEMA = "conv_id long, ord long, turn long, rendered string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A message in the template, and the span under the loss mask: an assistant's text."""
    head, body = TURN + escape(role) + TEXT, escape(text)
    start = len(head)
    return head + body + END, start, start + len(body) if role == "assistant" else start


def parse(rendered: str) -> tuple[str, str]:
    role, _, text = rendered[len(TURN) : -len(END)].partition(TEXT)
    return unescape(role), unescape(text)


_START = object()


def _messages(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["conv_id", "ord", "turn", "rendered", "loss_start", "loss_end"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events sorted by conversation, turn and sequence to rendered messages."""
    conv, turn, role, text, open_, dropped, kept_drop, ord_ = _START, _START, "", [], False, None, None, 0
    out: list[tuple] = []

    def close() -> None:
        nonlocal ord_, open_
        if open_:
            out.append((conv, ord_, turn, *render(role, "".join(text))))
            ord_, open_ = ord_ + 1, False

    for batch in batches:
        for c, t, s, kind, r, x in zip(*(batch[n].to_pylist() for n in ("conv_id", "turn", "seq", "kind", "role", "text"))):
            if c != conv:
                close()
                conv, turn, ord_, dropped, kept_drop, role = c, _START, 0, None, None, ""
            if t != turn:
                close()
                turn, dropped, role = t, kept_drop, ""  # a role holds for its turn
            if dropped is not None and s < dropped:
                continue
            if kind == "regenerate":
                text, kept_drop, role = [], s if kept_drop is None else max(kept_drop, s), r or role
                open_ = True
            elif kind == "delta":
                text, role, open_ = (text if open_ else []) + [x], r or (role if open_ else ""), True
            elif kind == "edit":
                text, role, open_ = [x], r or (role if open_ else ""), True
            else:
                close()
                text, role, open_ = [x], r, True
        if out:
            yield _messages(out)
            out = []
    close()
    if out:
        yield _messages(out)


def format_chats(events: DataFrame) -> DataFrame:
    """Events (conv_id, seq, kind, turn, role, text) to one row per final message, rendered.

    Partitions hold whole conversations, sorted by conv_id and ord: a later step may go on in the same pass.
    """
    log = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"),
        F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = log.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")
    return dealt.mapInArrow(_fold, MESSAGE_SCHEMA)


DIGEST = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rendered messages, whole conversations in order, to what each conversation's output reads back as."""
    out: list[tuple] = []
    conv, turns, loss, n, n_loss, chars = _START, None, None, 0, 0, 0

    def close() -> None:
        if n:
            out.append((conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), chars))

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), _KINDS)], DIGEST)

    for batch in batches:
        for c, rendered, a, b in zip(*(batch[x].to_pylist() for x in ("conv_id", "rendered", "loss_start", "loss_end"))):
            if c != conv:
                close()
                conv, turns, loss, n, n_loss, chars = c, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            role, text = parse(rendered)
            turns.update(f"{role}\n{text}\n".encode())
            masked = unescape(rendered[a:b])
            loss.update(masked.encode())
            n, n_loss, chars = n + 1, n_loss + len(masked), chars + len(rendered)
        if out:
            yield done()
            out = []
    close()
    if out:
        yield done()


def chat_digest(messages: DataFrame) -> DataFrame:
    return messages.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Characters of a streamed delta in the log that the query derives.
DELTA_CHARS = 200


def event_log(rows: DataFrame) -> DataFrame:
    """The log that ends in these messages (conv_id, turn, role, text), as a chat service would have written it.

    An assistant's answer is a message with a draft, which is regenerated and streamed in deltas; any other message is posted
    with an error and edited. Messages follow each other by turn, then role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / DELTA_CHARS).cast("int")), lambda i: F.substring(text, i * DELTA_CHARS + 1, F.lit(DELTA_CHARS)))
    pieces = F.when(F.length(text) > 0, pieces).otherwise(F.array(F.lit("")))
    event = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))
    draft = F.substring(text, 1, 20)
    answer = F.concat(F.array(event("message", draft), event("regenerate", F.lit(""))), F.transform(pieces, lambda x: event("delta", x)))
    posted = F.array(event("message", F.concat(draft, F.lit("?"))), event("edit", text))
    log = rows.withColumn("nth", F.row_number().over(order)).withColumn("events", F.when(F.col("role") == "assistant", answer).otherwise(posted))
    log = log.select("conv_id", "turn", "role", "nth", F.posexplode("events").alias("step", "event"))
    return log.select("conv_id", (F.shiftleft(F.col("nth").cast("long"), 32) + F.col("step")).alias("seq"), F.col("event.kind").alias("kind"), "turn", "role", F.col("event.text").alias("text"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, as logs of messages, deltas, edits and regenerations that are folded, rendered and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string"))
    return chat_digest(format_chats(event_log(rows)))


ORACLE = r"""
WITH r AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(text) + len(text) - len(replace(text, '\', '')) + len(text) - len(replace(text, '<', '')) + len(text) - len(replace(text, '[', '')) AS n,
  len(role) + len(role) - len(replace(role, '\', '')) + len(role) - len(replace(role, '<', '')) + len(role) - len(replace(role, '[', '')) AS m FROM r)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(COALESCE(SUM(CASE WHEN role = 'assistant' THEN len(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(SUM(n + m + 23) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
