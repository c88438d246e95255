"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Every document is cut into pieces of at most the capacity, the first of which may be shorter. Full pieces are sequences of
their own. The others are packed best-fit (largest first, into the fullest bin that takes it) inside each partition; bins
that are nearly full leave as sequences, and the underfull ones go up a tree as single items: partitions are merged
``FAN_IN`` to one, and the bins are packed best-fit again. The tree ends when one task has the rest, or when a round no
longer reduces the number of bins noticeably (then more rounds can't either). A task of any level holds at most
``TASK_ITEMS`` items for each input of the level before; a bin has at most ``capacity`` members.

``pieces`` gives the token ids of each piece, ``place`` puts pieces of any kind in their places, ``pack`` does both. Null or
empty texts are the end id alone. Repeated rows are packed each on their own; null doc_ids are kept. An empty table gives no
rows. Extra columns of documents are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm import textkernel as K
from terravane.llm import tokens as T
from terravane.llm.shared import batches, stored

CAPACITY = 1024
#: A bin with at most this much room leaves at once; the last level lets all leave.
NEARLY_FULL = 4
FAN_IN = 8
#: Items of one task of the tree's lowest level, about.
TASK_ITEMS = 100_000
#: The tree goes on while a round leaves fewer than this share of the bins it got.
WORTH = 0.98


def _pieces(it: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = T.encoder(tokenizer)
    for batch in it:
        for i, j in K.slices(batch.column(1), T.SLICE_BYTES):
            part = batch.slice(i, j - i)
            ids, offsets = encoder.encode(part.column(1))
            n = np.diff(offsets)
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            lead = n - (count - 1) * capacity
            start = np.where(piece == 0, 0, lead[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, lead[doc], capacity)
            at = offsets[:-1][doc] + start
            crc = np.fromiter((zlib.crc32(ids[a:b]) for a, b in zip(at, at + length, strict=True)), dtype=np.int64, count=len(at))
            columns = [part.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([ids[a:b].tobytes() for a, b in zip(at, at + length, strict=True)], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start (ids of the document before it), length, ids_crc32 and, if asked for, ids (unsigned 32-bit, little-endian)."""
    batches(docs)
    path = tokenizer or T.default_tokenizer()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _pieces(it, path, capacity, with_ids), schema)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of positions in ``sizes``: largest first, each into the fullest bin that still takes it."""
    by_size: dict[int, list[int]] = {}
    for at in np.argsort(-sizes, kind="stable").tolist():
        by_size.setdefault(int(sizes[at]), []).append(at)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room
    rooms = np.zeros(capacity + 1, dtype=bool)
    bins: list[list[int]] = []
    for size, items in by_size.items():
        for at in items:
            fits = rooms[size:].argmax() + size if size <= capacity else 0
            if size <= capacity and rooms[fits]:
                b = open_bins[fits].pop()
                rooms[fits] = bool(open_bins[fits])
                bins[b].append(at)
                room = int(fits) - size
            else:
                b, room = len(bins), capacity - size
                bins.append([at])
            if room > 0:
                open_bins[room].append(b)
                rooms[room] = True
    return bins


def _pack(it: Iterator[pa.RecordBatch], capacity: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Packs the bins (size, members) of a partition, in memory-bounded rounds of TASK_ITEMS * FAN_IN."""
    held: list[pa.RecordBatch] = []
    n = 0

    def packed() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        sizes = np.asarray(table.column("size"))
        lists = table.column("members").combine_chunks()
        bins = best_fit(sizes, capacity)
        order = np.fromiter((at for b in bins for at in b), dtype=np.int64, count=len(sizes))
        lengths = np.fromiter(map(len, bins), dtype=np.int64, count=len(bins))
        own = np.repeat(np.arange(len(bins)), lengths)
        base = np.cumsum(sizes[order]) - sizes[order]
        firsts = np.cumsum(lengths) - lengths
        base = base - base[firsts][own]  # tokens of the bin before the item
        taken = lists.take(pa.array(order))
        members, counts = taken.flatten(), np.diff(np.asarray(taken.offsets))
        offset = np.asarray(members.field("offset")) + np.repeat(base, counts)
        fields = list(members.type)
        flat = pa.StructArray.from_arrays([pa.array(offset) if f.name == "offset" else members.field(k) for k, f in enumerate(fields)], fields=fields)
        totals = np.add.reduceat(sizes[order], firsts)
        run = np.concatenate([[0], np.cumsum(counts)])
        ends = np.concatenate([run[firsts], run[-1:]])
        filled = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
        done = np.ones(len(bins), dtype=bool) if last else totals >= capacity - NEARLY_FULL
        yield from pa.Table.from_arrays([pa.array(totals.astype(np.int32)), filled, pa.array(done)], names=["size", "members", "done"]).to_batches(max_chunksize=5000)

    for batch in it:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= TASK_ITEMS * FAN_IN:
            yield from packed()
            held, n = [], 0
    if held:
        yield from packed()


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``pieces`` (with a column length from 1 to capacity; any other columns) with sequence_id and offset."""
    pieces = pieces.drop("sequence_id", "offset")
    at_start = F.lit(0).cast("long")
    own_sequence = lambda level: F.monotonically_increasing_id() * 16 + level
    found = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": own_sequence(0), "offset": at_start})
    items = pieces.where(F.col("length") < capacity).select(F.col("length").cast("int").alias("size"), F.array(F.struct(*pieces.columns, at_start.alias("offset"))).alias("members"))
    schema = f"size int, members {items.schema['members'].dataType.simpleString()}, done boolean"
    n, last, level = None, False, 0
    while True:
        level += 1
        out = stored(items.mapInArrow(lambda it, last=last: _pack(it, capacity, last), schema), "bins")
        left = out.where("not done")
        m = 0 if last else left.count()
        stop = not m or level == 15 or (n is not None and m > WORTH * n)
        done = (out if stop else out.where("done")).withColumn("sequence_id", own_sequence(level)).select("sequence_id", F.explode("members").alias("m"))
        found = found.unionByName(done.select("m.*", "sequence_id").select(*pieces.columns, "sequence_id", "offset"))
        if stop:
            return found
        tasks = -(-m // TASK_ITEMS) if n is None else -(-tasks // FAN_IN)
        n, last = m, tasks == 1
        items = left.select("size", "members").repartition(tasks)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (if asked for), sequence_id and offset of every piece of ``docs`` (doc_id, text)."""
    return place(stored(pieces(docs, tokenizer, capacity, with_ids), "pieces"), capacity)
