"""Conversations from event logs: fold deltas, edits and regenerations into messages, render, read back.

An event is (conv_id, seq, kind, message, role, text). ``open`` starts a message, ``delta`` appends text,
``edit`` replaces it, ``regenerate`` empties it for a new try, ``delete`` takes the message away. Events
of a message are folded by aggregation; conversations are partitioned, sorted and rendered as a stream,
so a task holds one message and one part of a conversation, however long the conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The template: ``### role: text</turn>`` and a line end. Escaped characters cannot form its marks.
HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
ESCAPED, ESCAPED_ROLE = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]")
TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.)*+)</turn>\n", re.S)
ESCAPE = re.compile(r"\\(.)", re.S)
LEARNED = "assistant"
#: Code points after which a conversation goes on in its next part, and code points of a delta.
PART, DELTA = 1 << 20, 2000


def escape(text: str, marks: re.Pattern = ESCAPED) -> str:
    return marks.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPE.sub(r"\1", text)


def event_log(turns: DataFrame, delta: int = DELTA) -> DataFrame:
    """The log that would have streamed the given rows (conv_id, turn, role, text), text in deltas.

    Rows go by turn, null turns first; rows of one turn go by role and text, and each is a message of its
    own. Null texts and roles are empty; null conversations are one conversation.
    """
    numbered = turns.select(
        "conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long").alias("message"),
    )
    pieces = F.transform(
        F.sequence(F.lit(0), F.ceil(F.length("text") / delta).cast("int")),
        lambda k: F.when(k == 0, F.struct(k.alias("k"), F.lit("open").alias("kind"), F.lit("").alias("text"))).otherwise(
            F.struct(k.alias("k"), F.lit("delta").alias("kind"), F.substring("text", (k - 1) * delta + 1, F.lit(delta)).alias("text"))
        ),
    )
    return numbered.select("conv_id", "message", "role", F.explode(pieces).alias("e")).select(
        "conv_id", (F.col("message") * (1 << 24) + F.col("e.k")).alias("seq"), F.col("e.kind").alias("kind"), "message", "role", F.col("e.text").alias("text")
    )


def messages(log: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) after all events, in whatever order the log's rows come.

    An event that comes twice counts once. What precedes a message's last edit or regeneration is
    dropped; the role is that of its last ``open``; a message whose last event is ``delete`` goes.
    """
    log = log.dropDuplicates(["conv_id", "message", "seq"])
    kind = F.col("kind")
    folded = log.groupBy("conv_id", "message").agg(
        F.max_by("role", F.when(kind == "open", F.col("seq"))).alias("role"),
        F.max_by("kind", "seq").alias("last"),
        F.max(F.when(kind.isin("edit", "regenerate"), F.col("seq"))).alias("reset"),
        F.sort_array(F.collect_list(F.when(kind.isin("delta", "edit"), F.struct("seq", "text")))).alias("said"),
    )
    said = F.filter("said", lambda e: F.col("reset").isNull() | (e["seq"] >= F.col("reset")))
    return folded.where("last <> 'delete'").select(
        "conv_id", "message", F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(said, lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"),
    )


def _conv(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def rendered(said: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, formatted, loss): the conversations as training text.

    ``loss`` holds (start, end) code points of the learned texts within the part. A turn is never cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number, out, spans, size, begun = None, 0, [], [], 0, False

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv_id": conv, "part": number, "formatted": "".join(out), "loss": spans}], schema=shape)

        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if begun and (c != conv or size >= part):
                    yield flush()
                    number, out, spans, size = (number + 1 if c == conv else 0), [], [], 0
                conv, begun = c, True
                head, body = HEAD + escape(role, ESCAPED_ROLE) + COLON, escape(text)
                if role == LEARNED:
                    spans.append({"start": size + len(head), "end": size + len(head) + len(body)})
                out += [head, body, TAIL]
                size += len(head) + len(body) + len(TAIL)
        if begun:
            yield flush()

    kind = _conv(said)
    shape = pa.schema([
        ("conv_id", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), ("part", pa.int32()),
        ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ])
    ordered = said.repartition("conv_id").sortWithinPartitions("conv_id", "message").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, part int, formatted string, loss array<struct<start: bigint, end: bigint>>")


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, from the rendered text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun = None, False
        turns = chars = loss_chars = 0
        said, loss = hashlib.sha256(), hashlib.sha256()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"conv_id": conv, "n_turns": turns, "turns_sha256": said.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}],
                schema=shape,
            )

        for batch in batches:
            for c, text, spans in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss"))):
                if begun and c != conv:
                    yield flush()
                    turns = chars = loss_chars = 0
                    said, loss = hashlib.sha256(), hashlib.sha256()
                conv, begun = c, True
                at = 0
                for m in TURN.finditer(text):
                    if m.start() != at:
                        raise ValueError(f"No turn at {at} of conversation {c}")
                    at = m.end()
                    said.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                    turns += 1
                if at != len(text):
                    raise ValueError(f"No turn at {at} of conversation {c}")
                chars += len(text)
                for span in spans:
                    learned = unescape(text[span["start"] : span["end"]])
                    loss.update(learned.encode("utf-8", "surrogatepass"))
                    loss_chars += len(learned)
        if begun:
            yield flush()

    kind = _conv(parts)
    shape = pa.schema([
        ("conv_id", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "formatted", "loss")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted(turns: DataFrame) -> DataFrame:
    """Rows to log, log to messages, messages to training text. An empty table gives no rows."""
    return rendered(messages(event_log(turns.select("conv_id", "turn", "role", "text"))))
