"""Chat formatting: an event log folded into conversations, then rendered with a mask for the loss.

Events have a conversation, a turn, a message, a sequence number and a kind: `open` starts a message with a role and
text, `delta` appends text, `edit` replaces the text so far, `regenerate` empties it before new deltas, `delete`
removes the message. The log is partitioned by conversation and sorted by sequence once; each task then reads its
events in order and folds them one by one, holding the parts of one message. What comes out is one row a turn, so a
conversation of any length is never a single value; its rows follow one another in order.

The template writes `<|im_start|>role`, a line end, the text and `<|im_end|>` with a line end. Inside roles and
texts every `<|` becomes `<\\|`, and a `<` followed by backslashes and `|` gets one backslash more, so that no
text can hold a mark and the reading is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

START, END = "<|im_start|>", "<|im_end|>"
PROBE = f"{END}{START}assistant ok"
ESCAPE, UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escaped(text: str) -> str:
    return ESCAPE.sub(r"<\1\\|", text)


def unescaped(text: str) -> str:
    return UNESCAPE.sub(r"<\1|", text)


def role_out(role: str) -> str:
    """A role on one line."""
    return escaped(role).replace("\\", "\\\\").replace("\n", "\\n")


def role_in(line: str) -> str:
    return unescaped(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], line))


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the code-point spans of it that count for the loss: assistants' texts."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{role_out(role)}\n", escaped(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        role_end = formatted.index("\n", at)
        end = formatted.index(END, role_end)
        turns.append((role_in(formatted[at + len(START) : role_end]), unescaped(formatted[role_end + 1 : end])))
        at = end + len(END) + 1
    return turns


#: Characters of a delta in the log that is made of finished texts; characters that a task gathers before it passes them on.
DELTA, OUT_CHARS = 400, 1 << 24


def events_of(rows: DataFrame, delta: int = DELTA) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as the log of a session that led to them.

    Every message is opened empty and streamed in deltas of `delta` characters. By a digest of the row, some messages
    have a first delta that is regenerated away, some are streamed up to the middle and then edited to their text,
    and some are followed by a further message of the turn that is deleted again. Repeated rows and rows of one turn stay
    separate messages, ordered by role and a digest of the text.
    """
    text = F.coalesce("text", F.lit(""))
    each = rows.select(
        "conv_id", "turn", "role", text.alias("text"), F.concat_ws(" ", F.coalesce("role", F.lit("")), F.hex(F.xxhash64(text)), F.monotonically_increasing_id().cast("string")).alias("message"),
        F.pmod(F.xxhash64("conv_id", "turn", "role"), F.lit(8)).alias("way"),
    )
    event = lambda seq, kind, text, message=F.col("message"): F.struct(seq.cast("int").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"), message.alias("message"))
    deltas = lambda first, length: F.when(length > 0, F.transform(F.sequence(F.lit(0), F.floor((length - 1) / delta)), lambda i: event(i + first, "delta", F.substring("text", i.cast("int") * delta + 1, F.least(F.lit(delta), (length - i * delta)).cast("int"))))).otherwise(F.array())
    one, two, length = F.lit(1), F.lit(2), F.length("text").cast("int")
    opened = F.array(event(F.lit(0), "open", F.lit("")))
    half = F.floor(length / 2).cast("int")
    straight = F.concat(opened, deltas(one, length))
    again = F.concat(opened, F.array(event(one, "delta", F.reverse(F.substring("text", 1, delta))), event(two, "regenerate", F.lit(""))), deltas(F.lit(3), length))
    edited = F.concat(opened, deltas(one, half), F.array(event(half + two, "edit", F.col("text"))))
    other = F.concat(F.col("message"), F.lit("+"))
    beside = F.concat(straight, F.array(event(F.lit(0), "open", F.lit("never mind"), other), event(one, "delete", F.lit(""), other)))
    log = F.when(F.col("way") == 0, again).when(F.col("way") == 1, edited).when(F.col("way") == 2, beside).otherwise(straight)
    return each.select("conv_id", "turn", "role", F.explode(log).alias("e")).select("conv_id", "turn", "e.message", "role", "e.seq", "e.kind", "e.text")


class Message:
    """A message as its events so far leave it; one step an event, whatever came before."""

    def __init__(self):
        self.role: str | None = None
        self.parts: list[str] = []
        self.gone = False

    def add(self, role: str | None, kind: str, text: str | None) -> None:
        if role is not None and (self.role is None or role > self.role):
            self.role = role
        if kind in ("open", "edit", "regenerate"):
            self.parts.clear()
        if kind in ("open", "edit", "delta") and text:
            self.parts.append(text)
        self.gone = kind == "delete"


def ordered(events: DataFrame) -> DataFrame:
    """The log by conversation, each in order of turn, message and sequence; ties by kind and text."""
    own = events.select("conv_id", "turn", F.col("message").cast("string").alias("message"), "role", F.col("seq").cast("long").alias("seq"), "kind", F.coalesce("text", F.lit("")).alias("text"))
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "message", "seq", "kind", "text")


def format_log(events: DataFrame) -> DataFrame:
    """conv_id, place, start, formatted, mask of every turn: a conversation's rows are together and in order.

    The formatted conversation is its rows' `formatted`, one after the other; start is the code point at which a row
    begins, mask an array of struct<start,end> of the code points inside the row that count for the loss. A null
    conv_id is a conversation of its own, null turns come first; null texts and roles are empty; events without an
    `open` still make a message; events of a message share its role; deleted messages are gone; messages and
    conversations of any length are read through.
    """
    small_batches(events.sparkSession)
    mask = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kind = events.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "place", "start", "formatted", "mask"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, place, start = None, 0, 0
        message, at = None, None
        done: list[tuple] = []
        held = 0

        def close() -> None:
            nonlocal place, start, held
            if message is not None and not message.gone:
                text, spans = rendered([(message.role or "", "".join(message.parts))])
                done.append((at[0], place, start, text, [{"start": a, "end": z} for a, z in spans]))
                place, start, held = place + 1, start + len(text), held + len(text)

        def out(conv: pa.DataType) -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*done, strict=True))
            done.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (conv, pa.int64(), pa.int64(), pa.string(), mask), strict=True)], names)

        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for conv, turn, key, role, what, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "message", "role", "kind", "text")), strict=True):
                if (conv, turn, key) != at:
                    close()
                    if at is None or conv != conversation:
                        conversation, place, start = conv, 0, 0
                    message, at = Message(), (conv, turn, key)
                    if held > OUT_CHARS:
                        yield out(conv_type)
                message.add(role, what, text)
            if done:
                yield out(conv_type)
        close()
        if done:
            yield out(conv_type)

    return ordered(events).mapInArrow(run, f"conv_id {kind}, place bigint, start bigint, formatted string, mask array<struct<start:bigint,end:bigint>>")


def conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, mask of whole conversations, for those that fit in one value."""
    turns = F.array_sort(F.collect_list(F.struct("place", "start", "formatted", "mask")))
    spans = F.flatten(F.transform("turns", lambda t: F.transform(t["mask"], lambda m: F.struct((m["start"] + t["start"]).alias("start"), (m["end"] + t["start"]).alias("end")))))
    return formatted.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.array_join("turns.formatted", "").alias("formatted"), spans.alias("mask"))


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations finds, turn by turn in the order of format_log's rows."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, conv_type = None, None

        def closed() -> tuple:
            conv, n, whole, loss_n, loss, chars = open_
            return (conv, n, whole.hexdigest(), loss_n, loss.hexdigest(), chars)

        for batch in batches:
            conv_type, done = batch.schema.field("conv_id").type, []
            for conv, rows in groupby(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "formatted", "mask")), strict=True), key=lambda r: r[0]):
                for _, place, text, mask in rows:
                    if place == 0:
                        if open_ is not None:
                            done.append(closed())
                        open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, said in read_back(text):
                        open_[1] += 1
                        open_[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    for m in mask:
                        loss = unescaped(text[m["start"] : m["end"]])
                        open_[3] += len(loss)
                        open_[4].update(loss.encode("utf-8", "surrogatepass"))
                    open_[5] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (conv_type, *kinds), strict=True)], names)
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(closed(), (conv_type, *kinds), strict=True)], names)

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def with_probe(rows: DataFrame) -> DataFrame:
    probe = rows.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and the probe, read back from their formatted form."""
    return digests(format_log(events_of(with_probe(table(spark, sf_dir, "conversations")))))
