"""Token-id files: every document's ids compressed on its own with one shared zstandard dictionary, and an offset index.

The dictionary is trained on the serialised ids of at most ``SAMPLE_DOCS`` documents (the smallest hashes of their ids; of one with more
than ``SAMPLE_IDS`` ids, ``SPANS`` spans spread evenly over it; a model, so its sample is bounded), and is stored beside the data. A data file is a Parquet
table that Spark writes, so that it works in any store and survives lost tasks. Its rows are blocks of up to ``BLOCK_DOCS``
neighbouring documents in ascending order of doc_id:

    part int, block long  the task that wrote it (parts ascend with doc_id), its number there
    dict_hash string      SHA-256 of the dictionary that its frames need
    doc_ids list<long>    the documents, ascending
    token_ends list<long> ids of the block up to the end of each, with the end ids
    ends list<long>       end of each document's frame in ``frames`` (the first begins at 0)
    frames binary         zstandard frames, one a document, end to end
    tokens_before long    ids of the part's blocks before

A reader takes one document's frame by its two ends, without touching its neighbours. Ids are unsigned 16-bit if all ids of the
tokenizer's file fit, else 32-bit, little-endian, with the first byte of each id before the second ones.

Null or empty texts are the end id alone. Rows with a null doc_id come first. Repeated doc_ids are kept, in order of their
frames' hashes. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.llm import textkernel as K
from terravane.llm import tokens as T
from terravane.llm.shared import batches, drop, stored

SAMPLE_DOCS, SAMPLE_IDS, SPANS = 1000, 2000, 4
DICT_BYTES = 64_000
LEVEL = 3
BLOCK_DOCS, BLOCK_BYTES = 256, 4_000_000


def serialise(ids: np.ndarray, width: int) -> bytes:
    """The ids' bytes, all low bytes first, then all next ones."""
    if len(ids) and int(ids.max()) >> (8 * width):
        raise ValueError(f"an id doesn't fit in {width} bytes")
    return ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def deserialise(data: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype("<u4")


def spread(ids: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` of the ids: all, or SPANS spans evenly spread, the first and the last ones among them."""
    if len(ids) <= most:
        return ids
    size = most // SPANS
    return np.concatenate([ids[at : at + size] for at in np.linspace(0, len(ids) - size, SPANS).astype(int)])


def _encoded(it: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    encoder = T.encoder(tokenizer)
    for batch in it:
        for i, j in K.slices(batch.column(1), T.SLICE_BYTES):
            part = batch.slice(i, j - i)
            ids, offsets = encoder.encode(part.column(1))
            yield part, [ids[a:b] for a, b in zip(offsets, offsets[1:])]


def train_dictionary(docs: DataFrame, tokenizer: str, width: int) -> bytes:
    """A dictionary of at most DICT_BYTES, or none if there are too few documents to train one."""
    chosen = docs.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(SAMPLE_DOCS).select("doc_id")
    sample = docs.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi")  # at most SAMPLE_DOCS ids

    def ids_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lists in _encoded(it, tokenizer):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([serialise(spread(x, SAMPLE_IDS), width) for x in lists], pa.binary())], names=["doc_id", "ids"])

    rows = sample.mapInArrow(ids_of, "doc_id long, ids binary").orderBy("doc_id", "ids").limit(2 * SAMPLE_DOCS).collect()
    samples = [bytes(r["ids"]) for r in rows]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, threads=1).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write(docs: DataFrame, path: str, tokenizer: str | None = None, width: int | None = None) -> None:
    """Writes ``docs`` (doc_id, text) to the folders ``dictionary`` and ``blocks`` under ``path``; ids of ``width`` bytes (default: as the vocabulary needs)."""
    spark = docs.sparkSession
    batches(docs)
    tokenizer = tokenizer or T.default_tokenizer()
    width = width or T.id_bytes(tokenizer)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    trained = train_dictionary(docs, tokenizer, width)
    digest = hashlib.sha256(trained).hexdigest()
    shared = spark.sparkContext.broadcast(trained)  # at most DICT_BYTES
    spark.createDataFrame([(digest, bytearray(trained), width)], "dict_hash string, data binary, width int").write.parquet(f"{path}/dictionary")

    def frames(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value))
        for part, lists in _encoded(it, tokenizer):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) for x in lists], pa.int64()), pa.array([squeeze.compress(serialise(x, width)) for x in lists], pa.binary())], names=["doc_id", "n_tokens", "frame"]
            )

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    encoded = stored(docs.mapInArrow(frames, "doc_id long, n_tokens long, frame binary"), "frames", "none")
    # rows of one id, or of none, go to many ranges too: by their frames, equal ones by their places in the stored table
    order = ["doc_id", F.xxhash64("frame"), F.monotonically_increasing_id()]
    ordered = encoded.select("*", *[c.alias(f"__{k}") for k, c in enumerate(order[1:])]).repartitionByRange(n, "doc_id", "__0", "__1").sortWithinPartitions("doc_id", "__0", "__1").drop("__0", "__1")

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = number = 0
        for batch in it:
            for a, b in K.slices(batch.column(2), BLOCK_BYTES):
                for i in range(a, b, BLOCK_DOCS):
                    part = batch.slice(i, min(b, i + BLOCK_DOCS) - i)
                    data, n = part.column(2).to_pylist(), part.column(1).to_pylist()
                    row = {"block": number, "doc_ids": part.column(0).to_pylist(), "token_ends": np.cumsum(n).tolist(), "ends": np.cumsum([len(x) for x in data]).tolist(), "frames": b"".join(data), "tokens_before": before}
                    yield pa.RecordBatch.from_pylist([row], schema=_BLOCK)
                    before, number = before + sum(n), number + 1

    cut = ordered.mapInArrow(blocks, "block long, doc_ids array<long>, token_ends array<long>, ends array<long>, frames binary, tokens_before long")
    cut = cut.withColumn("part", F.spark_partition_id()).withColumn("dict_hash", F.lit(digest))
    cut.write.option("compression", "none").parquet(f"{path}/blocks")
    drop(encoded)


_BLOCK = pa.schema([("block", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("doc_ids", "token_ends", "ends")), ("frames", pa.binary()), ("tokens_before", pa.int64())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit, little-endian) of every document of the files under ``path``."""
    blocks = batches(spark.read.parquet(f"{path}/blocks"))
    digest, data, width = spark.read.parquet(f"{path}/dictionary").first()
    shared = spark.sparkContext.broadcast(bytes(data))
    totals = blocks.groupBy("part").agg(F.max(F.col("tokens_before") + F.element_at("token_ends", -1)).alias("tokens"))
    # one row for each task that wrote, so the window and the broadcast are small
    base = totals.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("base"))

    blocks = blocks.join(F.broadcast(base), "part").select("dict_hash", "doc_ids", "token_ends", "ends", "frames", (F.col("base") + F.col("tokens_before")).alias("tokens_before"))

    def documents(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value))
        for batch in it:
            for k in range(batch.num_rows):
                if (hashed := batch.column(0)[k].as_py()) != digest:
                    raise ValueError(f"a block needs the dictionary {hashed}, there is {digest}")
                frames = memoryview(batch.column(4)[k].as_buffer())
                ends = [0, *batch.column(3)[k].as_py()]
                ids = [deserialise(expand.decompress(frames[a:b]), width).tobytes() for a, b in zip(ends, ends[1:])]
                token_ends = np.asarray(batch.column(2)[k].values, dtype=np.int64)
                n = np.diff(token_ends, prepend=0)
                start = batch.column(5)[k].as_py() + token_ends - n
                yield pa.RecordBatch.from_arrays([batch.column(1)[k].values, pa.array(start), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")
