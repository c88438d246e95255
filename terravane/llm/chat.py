"""Chat formatting by columnar byte assembly, with a loss mask over the assistants' texts.

A turn becomes ``<|im_start|>role``, a new line, the text, ``<|im_end|>`` and a new line. Inside roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``, and a role's new line becomes backslash n, so that no text can hold a control string and
the escaping can be undone. For an Arrow batch of sorted turns, the lengths of all segments give cumulative offsets; headers
and contents are scattered into one preallocated buffer, which is then the batch's string column.

Turns are sorted by conversation and turn (then role and text where turns repeat), in ranges of that order, so a conversation with
a large share of all turns, or with turns that are null or alike, goes to many tasks. A task formats its turns in parts: a part
holds turns of one conversation, at most ``PART_TURNS`` of them and about ``PART_BYTES`` of text (a longer turn is a part of its
own). Output rows: conv_id, part (a conversation's parts in this order, one after the other, are its text), n_turns, formatted, and
mask (start and end, in UTF-8 bytes of ``formatted``, of each assistant text). Null texts and roles are empty. Rows with a null
conv_id make one conversation; rows with a null turn come first. Repeated rows are turns of their own. Extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm import textkernel as K
from terravane.llm.shared import batches

# Fixed values of the template.
START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
ASSISTANT = "assistant"
PART_TURNS, PART_BYTES = 4096, 32_000_000
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(column: pa.Array, role: bool = False) -> pa.Array:
    column = pc.replace_substring(pc.fill_null(column, ""), "\\", "\\\\")
    column = pc.replace_substring(column, "<|", "<\\|")
    return pc.replace_substring(column, "\n", "\\n") if role else column


def unescape(text: str, role: bool = False) -> str:
    return _ESCAPED.sub(lambda m: "\n" if role and m[1] == "n" else m[1], text)


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer of all turns, the n + 1 offsets of the turns in it, and where each text starts and ends."""
    role_data, role_at = K.text_bytes(escape(role, role=True))
    text_data, text_at = K.text_bytes(escape(text))
    role_n, text_n = np.diff(role_at), np.diff(text_at)
    offsets = np.concatenate([[0], np.cumsum(len(START) + role_n + len(MIDDLE) + text_n + len(END))])
    buffer = np.empty(int(offsets[-1]), dtype=np.uint8)
    text_start = offsets[:-1] + len(START) + role_n + len(MIDDLE)
    for constant, at in ((START, offsets[:-1]), (MIDDLE, text_start - len(MIDDLE)), (END, text_start + text_n)):
        buffer[at[:, None] + np.arange(len(constant))] = np.frombuffer(constant, dtype=np.uint8)
    for data, source, n, at in ((role_data, role_at, role_n, offsets[:-1] + len(START)), (text_data, text_at, text_n, text_start)):
        buffer[np.repeat(at - source[:-1], n) + np.arange(len(data))] = data
    return buffer, offsets, text_start, text_start + text_n


def _cuts(conv: pa.Array, text: pa.Array) -> np.ndarray:
    """Where parts begin among sorted turns, and their number."""
    null = np.asarray(conv.is_null())
    key = np.asarray(conv.fill_null(0))
    change = np.concatenate([[True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])])
    for i, j in K.slices(text, PART_BYTES):
        change[i:j:PART_TURNS] = True
    return np.append(np.flatnonzero(change), len(conv))


def _formatted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, range, role, text) to parts, numbered by range and order."""
    number = 0
    for batch in it:
        for i, j in K.slices(batch.column(3), 8 * PART_BYTES):
            turns = batch.slice(i, j - i)
            conv, role, text = (turns.column(k) for k in (0, 2, 3))
            at = _cuts(conv, text)
            buffer, offsets, start, end = assemble(role, text)
            first = offsets[at]
            strings = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(buffer))
            ours = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(role, ASSISTANT), False)))
            group = np.searchsorted(at, ours, side="right") - 1
            spans = pa.StructArray.from_arrays([pa.array(start[ours] - first[group]), pa.array(end[ours] - first[group])], names=["start", "end"])
            mask = pa.ListArray.from_arrays(pa.array(np.searchsorted(group, np.arange(len(at))).astype(np.int32)), spans)
            parts = np.asarray(turns.column(1)).astype(np.int64)[at[:-1]] * 2**40 + number + np.arange(len(at) - 1)
            number += len(at) - 1
            yield pa.RecordBatch.from_arrays([conv.take(pa.array(at[:-1])), pa.array(parts), pa.array(np.diff(at)), strings.cast(pa.string()), mask], names=["conv_id", "part", "n_turns", "formatted", "mask"])


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, formatted and mask of ``conversations`` (conv_id, turn, role, text)."""
    batches(conversations)
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
        F.col("turn").cast("long").alias("turn"),
    )
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role"]
    # bounds of the ranges need the texts' beginnings only: equal ones stay together
    ranged = turns.repartitionByRange(n, *order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    rows = ranged.select("conv_id", F.spark_partition_id().alias("range"), "role", "text")
    return rows.mapInArrow(_formatted, "conv_id long, part long, n_turns long, formatted string, mask array<struct<start:long,end:long>>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted string, unescaped."""
    turns = []
    for turn in formatted.split(START.decode())[1:]:
        role, _, rest = turn.partition("\n")
        turns.append((unescape(role, role=True), unescape(rest.removesuffix(END.decode()))))
    return turns


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, part, formatted, mask) to one row for each conversation; only one string is held at a time."""
    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    now: list | None = None
    done: list[tuple] = []

    def close() -> None:
        done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

    for batch in it:
        for k in range(batch.num_rows):
            conv, formatted, mask = (batch.column(c)[k].as_py() for c in (0, 2, 3))
            if now is None or now[0] != conv:
                if now is not None:
                    close()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
            data = formatted.encode()
            for span in mask:
                text = unescape(data[span["start"] : span["end"]].decode())
                now[3] += len(text)
                now[4].update(text.encode())
            now[5] += len(formatted)
        if len(done) > 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, d)) for d in done], schema=out)
            done.clear()
    if now is not None:
        close()
    if done:
        yield pa.RecordBatch.from_pylist([dict(zip(out.names, d)) for d in done], schema=out)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output of ``format_chat``: one row for each conversation."""
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = formatted.select("conv_id", "part", "formatted", "mask").repartition(n, "conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
