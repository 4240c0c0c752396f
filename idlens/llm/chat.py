"""Chat formatting by columnar byte assembly.

A turn is written as

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Inside roles and texts a backslash is put before the bar of any `<|`, and one more
where there are some already (`<|` to `<\\|`, `<\\|` to `<\\\\|`), so no text holds a
control string and taking one backslash away gives it back; roles escape their line
breaks and backslashes besides.

Turns of one batch are assembled together: the lengths of all segments (headers, roles,
texts, ends) give their cumulative offsets, these the places where bytes go, and one
numpy scatter copies everything into a preallocated buffer that becomes the Arrow
column. Conversations are stretches of that buffer. Rows are range-partitioned by
(conversation, turn), so a very long conversation spans several partitions and batches:
it comes as several parts, in order, whose concatenation is the conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = b"<|im_start|>", b"<|im_end|>\n"
BREAK = b"\n"
LEARNED = "assistant"
PARTS = "conv_id bigint, part bigint, n_turns bigint, formatted string, loss array<struct<start:bigint,stop:bigint>>"
SUMMARY = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
           "formatted_chars bigint, n_parts bigint")
SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def escape_texts(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\1\\|")


def escape_roles(roles: pa.Array) -> pa.Array:
    # backslashes become ones that stand for themselves before line breaks become \n
    return escape_texts(pc.replace_substring(pc.replace_substring(roles, "\\", "\\b"), "\n", "\\n"))


def unescape(text: str) -> str:
    import re

    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return unescape(role).replace("\\n", "\n").replace("\\b", "\\")


def pieces(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, first byte and length of each value of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all turns in a row; where each turn begins (and the last ends); first and
    last byte of each text."""
    fixed = np.frombuffer(START + BREAK + END, np.uint8)
    role_bytes, role_at, role_len = pieces(escape_roles(roles))
    text_bytes, text_at, text_len = pieces(escape_texts(texts))
    n = len(role_len)
    # five segments a turn: start, role, break, text, end
    length = np.empty((n, 5), np.int64)
    length[:, 0], length[:, 1], length[:, 2], length[:, 3], length[:, 4] = len(START), role_len, len(BREAK), text_len, len(END)
    source = np.empty((n, 5), np.int64)  # in fixed + roles + texts
    base = len(fixed) + len(role_bytes)
    source[:, 0], source[:, 2], source[:, 4] = 0, len(START), len(START) + len(BREAK)
    source[:, 1], source[:, 3] = len(fixed) + role_at, base + text_at
    flat = length.ravel()
    target = np.concatenate([[0], np.cumsum(flat)])
    out = np.empty(target[-1], np.uint8)
    # scatter index: each byte's place in the source is its place in the output, moved
    # by the same distance for its whole segment
    step = 1 << 22
    segment_shift, every = source.ravel() - target[:-1], np.concatenate([fixed, role_bytes, text_bytes])
    for lo in range(0, len(out), step):  # bounded index memory, whatever the batch
        hi = min(lo + step, len(out))
        first, last = np.searchsorted(target, lo, "right") - 1, np.searchsorted(target, hi, "left")
        cover = np.minimum(target[first + 1:last + 1], hi) - np.maximum(target[first:last], lo)
        out[lo:hi] = every[np.arange(lo, hi) + np.repeat(segment_shift[first:last], cover)]
    starts = target[:-1].reshape(n, 5)
    return out, np.append(starts[:, 0], target[-1]), starts[:, 3], starts[:, 4]


def format_batch(conv: pa.Array, roles: pa.Array, texts: pa.Array, first_part: int) -> pa.RecordBatch:
    """A row for each conversation among consecutive turns."""
    roles, texts = (pc.fill_null(x.cast(pa.large_string()), "") for x in (roles, texts))
    data, turn_at, text_at, text_end = assemble(roles, texts)
    ids = pc.fill_null(conv, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    null = conv.is_null().to_numpy(zero_copy_only=False)
    new = np.flatnonzero((np.diff(ids) != 0) | (np.diff(null.astype(np.int8)) != 0)) + 1
    turns = np.concatenate([[0], new, [len(ids)]])
    offsets = turn_at[turns]
    formatted = pa.LargeStringArray.from_buffers(len(turns) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    learned = np.flatnonzero(pc.equal(roles, LEARNED).to_numpy(zero_copy_only=False))
    conversation = np.searchsorted(turns, learned, "right") - 1
    spans = pa.StructArray.from_arrays([
        pa.array(text_at[learned] - offsets[conversation]), pa.array(text_end[learned] - offsets[conversation])], ["start", "stop"])
    loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(conversation, np.arange(len(turns)), "left").astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([
        conv.take(pa.array(turns[:-1])), pa.array(first_part + np.arange(len(turns) - 1)), pa.array(np.diff(turns)), formatted, loss], schema=SCHEMA)


def format_chat(turns: DataFrame, batch_rows: int = 4096) -> DataFrame:
    """PARTS: formatted conversations with the byte spans of the texts to learn from.

    A conversation's rows with ascending `part`, put together, are the conversation;
    only one that crosses a partition or batch has several. Turns go by turn, nulls
    first; repeated turn numbers by role and text. Null roles and texts are empty; rows
    without conv_id form one conversation of their own. Other columns are not read.
    """
    order = ["conv_id", "turn", "role", "text"]
    # ranges are told by short keys, as the driver samples them; whole roles and texts only sort
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text").repartitionByRange(
        "conv_id", "turn", F.left("role", F.lit(16))).sortWithinPartitions(
        *order).withColumn("_task", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, batch_rows):
                part = batch.slice(lo, batch_rows)
                done = format_batch(part.column("conv_id"), part.column("role"), part.column("text"), (part.column("_task")[0].as_py() << 40) + made)
                made += done.num_rows
                yield done

    return rows.mapInArrow(run, PARTS)


class Reader:
    """Reads one conversation back, part by part."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.chars = self.learned = self.parts = 0

    def add(self, formatted: str, loss: list[dict]) -> None:
        raw = formatted.encode()
        self.parts += 1
        self.chars += len(formatted)
        for turn in formatted.split(START.decode())[1:]:
            role, _, text = turn.removesuffix(END.decode()).partition("\n")
            self.turns.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
            self.n += 1
        for span in loss:
            text = unescape(raw[span["start"]:span["stop"]].decode())
            self.loss.update(text.encode())
            self.learned += len(text)

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.n, self.turns.hexdigest(), self.learned, self.loss.hexdigest(), self.chars, self.parts


def read_back(parts: DataFrame) -> DataFrame:
    """SUMMARY of each conversation, from its formatted parts alone. A digest runs over a
    conversation in order, so its parts stream through one task, one part at a time."""
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    types = [pa.string() if "string" in c else pa.int64() for c in SUMMARY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: Reader | None = None
        last = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            done = []
            for conv, formatted, loss in zip(batch.column("conv_id").to_pylist(), batch.column("formatted"), batch.column("loss")):
                if reader is not None and conv != last:
                    done.append(reader.row(last))
                    reader = None
                if reader is None:
                    reader, last = Reader(), conv
                reader.add(formatted.as_py(), loss.as_py())
            if done:
                yield out(done)
        if reader is not None:
            yield out([reader.row(last)])

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, SUMMARY)
