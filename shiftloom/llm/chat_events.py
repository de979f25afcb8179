"""Chat formatting from event logs (op8).

A log has events (conv_id, message, seq, kind, role, text): ``message`` begins a message, or says it anew; ``delta``
appends streamed text; ``edit`` puts a text in place of the message's; ``regenerate`` drops its text, and what is
streamed next takes its place; ``delete`` takes the message out until it is said anew. The log is partitioned by
conversation and sorted by seq, once; a task folds its conversations as they stream by, one held at a time, and renders
each as it ends. Messages become turns in the order of their first events.

A turn is rendered as ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. In texts and roles a control string gets a backslash
after its first character, and one that has backslashes there gets one more, so the escape can be undone and no
control string of this or the other listed templates is left; in roles a line break is ``\\n``, a backslash ``\\\\``.
The loss mask covers the texts of ``TRAINED`` roles.

null text or role: as empty. A null conv_id is a conversation of its own. Events of equal seq: in the order of message,
kind, then text. Repeated rows of ``conversations``: turns of their own, one after the other. Empty table: no rows (the
query: conversation -1 alone). Other columns are not read. A conversation is one row of the result, so one task renders it,
however long it is; what is held of it beside that row is its messages' texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

TRAINED = ("assistant",)
START, END = "<|im_start|>", "<|im_end|>"
# Control strings of public chat templates, by first character and rest.
_RESTS = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|/?s>|</?SYS>>|/?INST\]"
CONTROL = re.compile(rf"([<\[])(\\*)({_RESTS})")
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escaped(text: str) -> str:
    return CONTROL.sub(r"\1\2\\\3", text)


def unescaped(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def escaped_role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role), flags=re.S)


class Fold:
    """The messages of a conversation, in the order of their first events: role, text in parts, whether it was taken out."""

    def __init__(self) -> None:
        self.messages: dict = {}

    def add(self, message, kind: str, role: str | None, text: str | None) -> None:
        state = self.messages.setdefault(tuple(message.values()) if isinstance(message, dict) else message, ["", [], False])
        if role is not None:
            state[0] = role
        if kind in ("message", "edit", "regenerate", "delete"):
            state[1], state[2] = [], kind == "delete"
        if text and kind not in ("regenerate", "delete"):
            state[1].append(text)

    def rendered(self) -> tuple[str, list[tuple[int, int]]]:
        """The conversation, and where in it (code points) the loss mask holds."""
        parts, loss, at = [], [], 0
        for role, texts, gone in self.messages.values():
            if gone:
                continue
            head, body = f"{START}{escaped_role(role)}\n", escaped("".join(texts))
            if role in TRAINED:
                loss.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, END, "\n"]
            at += len(head) + len(body) + len(END) + 1
        return "".join(parts), loss


FORMATTED = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def format_events(events: DataFrame, dealt: bool = False) -> DataFrame:
    """conv_id, formatted, and ``loss`` (start, end in code points) of each conversation that has a message left or not.
    ``dealt``: the events are partitioned by conv_id already."""
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, None

        def row() -> pa.RecordBatch:
            formatted, loss = fold.rendered()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((now, formatted, [{"start": a, "end": b} for a, b in loss]), FORMATTED, strict=True)], schema=FORMATTED)

        for batch in batches:
            for conv, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fold is None or conv != now:
                    if fold is not None:
                        yield row()
                    now, fold = conv, Fold()
                fold.add(*event)
        if fold is not None:
            yield row()

    log = events.select(F.col("conv_id").cast("long").alias("conv_id"), "message", "kind", "role", "text", "seq")
    log = log if dealt else log.repartition(parts, "conv_id")
    ordered = log.sortWithinPartitions("conv_id", "seq", "message", "kind", "text").select("conv_id", "message", "kind", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, formatted string, loss array<struct<start:long,end:long>>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    return [(unescaped_role(m[1]), unescaped(m[2])) for m in TURN.finditer(formatted)]


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from ``formatted``."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, formatted, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = read_back(formatted)
                said, learnt = hashlib.sha256(), hashlib.sha256()
                for role, text in turns:
                    said.update(f"{role}\n{text}\n".encode())
                masked = [unescaped(formatted[x["start"] : x["end"]]) for x in loss]
                for text in masked:
                    learnt.update(text.encode())
                rows.append((conv, len(turns), said.hexdigest(), sum(map(len, masked)), learnt.hexdigest(), len(formatted)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return conversations.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of(rows: DataFrame) -> DataFrame:
    """A log whose fold are the rows (conv_id, turn, role, text), partitioned by conv_id. By a draw on conversation and turn, a
    turn is said at once, with another message beside it that is deleted; streamed in three deltas; a draft that is
    edited; or an answer that is regenerated. Rows of one turn are messages one after the other."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.repartition(parts, "conv_id").withColumn("copy", copy)
    size = F.length("text")
    third, rest = (size / 3).cast("int"), (size * 2 / 3).cast("int")
    piece = lambda a, b: F.substring("text", a + 1, b - a)
    zero, nothing = F.lit(0), F.lit(None).cast("string")

    def said(*events) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("step"), F.lit(other).alias("other"), F.lit(kind).alias("kind"), text.alias("text")) for k, (kind, text, other) in enumerate(events)])

    ways = [
        said(("message", F.lit("never mind"), 1), ("message", F.col("text"), 0), ("delete", nothing, 1)),
        said(("message", nothing, 0), ("delta", piece(zero, third), 0), ("delta", piece(third, rest), 0), ("delta", piece(rest, size), 0)),
        said(("message", F.lit("a draft"), 0), ("edit", F.col("text"), 0)),
        said(("message", F.lit("another "), 0), ("delta", F.lit("answer"), 0), ("regenerate", nothing, 0), ("delta", piece(zero, rest), 0), ("delta", piece(rest, size), 0)),
    ]
    draw = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(len(ways)))
    way = F.when(draw == 0, ways[0]).when(draw == 1, ways[1]).when(draw == 2, ways[2]).otherwise(ways[3])
    log = turns.select("conv_id", "turn", "copy", "role", F.explode(way).alias("e"))
    message = F.struct("turn", "copy", F.col("e.other").alias("other"))
    return log.select("conv_id", message.alias("message"), F.struct("turn", "copy", F.col("e.step").alias("step")).alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def op8_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(format_events(events_of(rows.unionByName(probe)), dealt=True))
