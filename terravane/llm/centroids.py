"""Clustering by centroids with heap-ordered bounds, in whole numbers.

A vector that is assigned to a cluster has a gap: its distance to the next best centroid less that to its own. As centroids move,
the gap of each member of a cluster shrinks by no more than the way of its own centroid plus the longest way of another one. The
cluster adds these ways up (its drift), and keeps its members in a heap by gap plus the drift at the time they were measured: those
whose key the drift has reached are on top. They alone are popped and measured exactly against all centroids; the others can't have
changed sides, so nobody looks at them. Bounds are kept with a margin above rounding, so assignments are those of full comparison.

Vectors are stored once, in blocks of up to ``BLOCK`` in a bucketed table; each (block, cluster) has its heap, a row of the
bucketed table that the last round wrote. A round joins the two by block without a shuffle, and writes the new heaps together with
the block's change of each cluster's sum. Sums of changes are exact, so nothing is added up anew; the driver holds the ``k`` centroids
and their sums. A lost executor costs its tasks of the current round only.

Vectors without exactly ``dims`` components, or with a null or non-finite one, are left out, and so are those whose scaled
component is beyond a double. A scaled component of 2^52 or more is an error. A distance beyond a long is the largest long. A null id
is clustered like any other, hashed as the empty text. Repeated rows are vectors of their own; equal hashes go by the vector. With fewer than ``k``
vectors there are fewer centroids; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.shared import batches, drop, new_path, stored

K, ROUNDS, SEED, DIMS, SCALE = 8, 10, 3, 64, 1024
#: Vectors of a block.
BLOCK = 1024
#: Components below this are compared in doubles, where all sums are whole; below the next one in 64-bit integers; else in Python's.
IN_DOUBLES, IN_LONGS, MOST = 1 << 22, 1 << 27, 1 << 52
LONGEST = (1 << 63) - 1
#: Bounds are narrowed by this share, far above the rounding of a root.
MARGIN = 1e-9

_BLOCKS = "block long, ids array<long>, data binary, width int"
_HEAPS = "block long, sizes array<int>, keys binary, members binary, popped int, changes array<struct<at: int, by: long>>"
_HEAP_SCHEMA = pa.schema([("block", pa.int64()), ("sizes", pa.list_(pa.int32())), ("keys", pa.binary()), ("members", pa.binary()), ("popped", pa.int32()), ("changes", pa.list_(pa.struct([("at", pa.int32()), ("by", pa.int64())])))])


def whole(data: bytes, width: int, dims: int) -> np.ndarray:
    """A block's vectors as 64-bit integers."""
    return np.frombuffer(data, dtype=f"<i{width}").reshape(-1, dims).astype(np.int64)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid: doubles or 64-bit integers where they hold all sums, else Python's integers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if top < IN_DOUBLES:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    kind = np.int64 if top < IN_LONGS else object
    a, b = x.astype(kind), centroids.astype(kind)
    return np.stack([((a - c) ** 2).sum(1) for c in b], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, its squared distance, gap) of each vector; of equally near centroids the smaller number."""
    d = squared_distances(x, centroids)
    own = np.argmin(d, axis=1) if d.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in d], dtype=np.int64).reshape(-1)
    rows = np.arange(len(d))
    mine = d[rows, own]
    if d.shape[1] == 1:
        return own, mine, np.full(len(d), np.inf)
    rest = d.astype(np.float64)
    upper = np.sqrt(rest[rows, own])
    rest[rows, own] = np.inf
    return own, mine, np.sqrt(rest.min(axis=1)) * (1 - MARGIN) - upper * (1 + MARGIN)


class Heaps:
    """A block's heaps of (key, member), one for each cluster."""

    def __init__(self, k: int, sizes: np.ndarray | None = None, keys: bytes = b"", members: bytes = b""):
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]
        if sizes is not None:
            keys_, members_ = np.frombuffer(keys, "<f8").tolist(), np.frombuffer(members, "<i4").tolist()
            at = 0
            for j, n in enumerate(sizes):
                self.heaps[j] = list(zip(keys_[at : at + n], members_[at : at + n]))  # stored in the heap's own order
                at += n

    def fill(self, cluster: np.ndarray, keys: np.ndarray) -> None:
        for j, heap in enumerate(self.heaps):
            own = np.flatnonzero(cluster == j)
            heap.extend(zip(keys[own].tolist(), own.tolist()))
            heapq.heapify(heap)

    def expired(self, drift: np.ndarray) -> list[tuple[int, int]]:
        """Pops (cluster, member) of every gap that the drift has used up."""
        out = []
        for j, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[j]:
                out.append((j, heapq.heappop(heap)[1]))
        return out

    def push(self, cluster: np.ndarray, keys: np.ndarray, members: np.ndarray) -> None:
        for j, key, member in zip(cluster.tolist(), keys.tolist(), members.tolist()):
            heapq.heappush(self.heaps[j], (key, member))

    def flat(self) -> tuple[list[int], bytes, bytes]:
        rows = [r for heap in self.heaps for r in heap]
        return [len(h) for h in self.heaps], np.array([r[0] for r in rows], "<f8").tobytes(), np.array([r[1] for r in rows], "<i4").tobytes()

    def clusters(self, n: int) -> np.ndarray:
        out = np.zeros(n, dtype=np.int64)
        for j, heap in enumerate(self.heaps):
            out[[m for _, m in heap]] = j
        return out


def advance(x: np.ndarray, heaps: Heaps, centroids: np.ndarray, drift: np.ndarray, first: bool) -> tuple[int, dict[int, int]]:
    """One round of a block. Returns how many vectors were measured, and the changes of the clusters' sums and counts by place (cluster * (dims + 1) + component, the count last)."""
    k, dims = centroids.shape
    change = np.zeros((k, dims + 1), dtype=np.int64)
    if first:
        own, _, gap = nearest(x, centroids)
        heaps.fill(own, gap + drift[own])
        for j in range(k):
            change[j] = [*x[own == j].sum(axis=0).tolist(), int((own == j).sum())]
        popped = len(x)
    else:
        out = heaps.expired(drift)
        popped = len(out)
        if popped:
            old, members = (np.array(c, dtype=np.int64) for c in zip(*out))
            own, _, gap = nearest(x[members], centroids)
            heaps.push(own, gap + drift[own], members)
            for m, a, b in zip(members[own != old], old[own != old], own[own != old]):
                change[a, :dims] -= x[m]
                change[b, :dims] += x[m]
                change[a, dims] -= 1
                change[b, dims] += 1
    flat = change.ravel()
    at = np.flatnonzero(flat)
    return popped, dict(zip(at.tolist(), flat[at].tolist()))


def kept_vectors(vectors: DataFrame, id_column: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(id, x) of the usable vectors; x: array<double>, scaled and rounded down."""
    usable = (F.size("x") == dims) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float("inf")))
    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where(F.coalesce(usable, F.lit(False)))


def _in_blocks(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in it:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.floor(np.asarray(part.column(1).flatten()) * scale)
                top = np.abs(x).max(initial=0)
                if top >= MOST:
                    raise ValueError(f"a component times {scale} is beyond {MOST}")
                width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([x.astype(f"<i{width}").tobytes()], pa.binary()), pa.array([width], pa.int32())], names=["block", "ids", "data", "width"])
                number += 1

    return rows.mapInArrow(blocks, _BLOCKS)


def _bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """``df`` as a table in buckets of ``block`` in the shared folder: two such tables meet without a shuffle."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").option("path", path := new_path(spark, name)).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    table._terravane_path, table._terravane_name = path, name
    return table


def _forget(*tables: DataFrame | None) -> None:
    for table in tables:
        if table is not None:
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table._terravane_name}")
            drop(table)


def _start(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the smallest hashes of ``seed``:``id``, in ascending order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [r["x"] for r in rows.select(hashed.alias("h"), "x").orderBy("h", "x").limit(k).collect()]


def _ways(old: list[list[int]], new: list[list[int]]) -> np.ndarray:
    """How far each centroid moved and the longest way of another one, together."""
    moved = np.array([math.sqrt(sum((a - b) ** 2 for a, b in zip(p, q))) for p, q in zip(old, new)]) * (1 + MARGIN)
    return np.array([m + max([*moved[:j], *moved[j + 1 :]], default=0.0) for j, m in enumerate(moved)])


def assign(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE, id_column: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]], list[int]]:
    """Clusters ``vectors``. Returns the stored rows (id, cluster, distance) of the last assignment, the centroids, and how many vectors each round measured."""
    spark = vectors.sparkSession
    batches(vectors)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = kept_vectors(vectors, id_column, vector, dims, scale)
    centroids = [[math.floor(c * scale) for c in x] for x in _start(rows, k, seed)]
    if not centroids:
        return spark.createDataFrame([], "id long, cluster int, distance long"), [], []
    blocks = _bucketed(_in_blocks(rows, dims, scale).repartition(buckets, "block"), "vectors", buckets)
    drift, sums = np.zeros(len(centroids)), [0] * (len(centroids) * (dims + 1))
    heaps, measured = None, []

    def joined() -> DataFrame:
        none = [F.lit(None).cast(kind).alias(c) for c, kind in (("sizes", "array<int>"), ("keys", "binary"), ("members", "binary"))]
        return blocks.select("*", *none) if heaps is None else blocks.join(heaps.select("block", "sizes", "keys", "members").hint("shuffle_hash"), "block")

    def restored(batch: pa.RecordBatch, i: int, k: int, now: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, Heaps, int, dict[int, int]]:
        number, ids, data, width, sizes, keys, members = (batch.column(c)[i] for c in ("block", "ids", "data", "width", "sizes", "keys", "members"))
        x = whole(data.as_py(), width.as_py(), dims)
        own = Heaps(k, sizes.as_py(), keys.as_py(), members.as_py()) if sizes.is_valid else Heaps(k)
        return x, own, *advance(x, own, now, drift, not sizes.is_valid)

    def round_of(now: np.ndarray, drift: np.ndarray):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for i in range(batch.num_rows):
                    _, own, popped, changes = restored(batch, i, len(now), now, drift)
                    sizes, keys, members = own.flat()
                    row = {"block": batch.column("block")[i].as_py(), "sizes": sizes, "keys": keys, "members": members, "popped": popped, "changes": [{"at": a, "by": b} for a, b in changes.items()]}
                    yield pa.RecordBatch.from_pylist([row], schema=_HEAP_SCHEMA)

        return run

    def last(now: np.ndarray, drift: np.ndarray):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for i in range(batch.num_rows):
                    x, own, *_ = restored(batch, i, len(now), now, drift)
                    cluster = own.clusters(len(x))
                    distance = np.empty(len(x), dtype=object)
                    for j in range(len(now)):
                        at = np.flatnonzero(cluster == j)
                        distance[at] = [min(int(d), LONGEST) for d in squared_distances(x[at], now[j : j + 1])[:, 0]]
                    ids = batch.column("ids")[i].values
                    yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance.tolist(), pa.int64())], names=["id", "cluster", "distance"])

        return run

    for _ in range(rounds):
        before = heaps
        heaps = _bucketed(joined().mapInArrow(round_of(np.array(centroids, dtype=np.int64), drift), _HEAPS), "heaps", buckets)
        _forget(before)
        measured.append(heaps.agg(F.sum("popped")).first()[0])
        changes = heaps.select(F.explode("changes").alias("c")).groupBy("c.at").agg(F.sum(F.col("c.by").cast("decimal(38,0)")).alias("by")).collect()  # a row for each component of a centroid, at most
        for r in changes:
            sums[r["at"]] += int(r["by"])
        moved = [[sums[j * (dims + 1) + d] // n for d in range(dims)] if (n := sums[j * (dims + 1) + dims]) else centroids[j] for j in range(len(centroids))]
        drift, centroids, stays = drift + _ways(centroids, moved), moved, moved == centroids
        if stays:  # so would all later rounds
            break
    found = stored(joined().mapInArrow(last(np.array(centroids, dtype=np.int64), drift), "id long, cluster int, distance long"), "clustered")
    _forget(blocks, heaps)
    return found, centroids, measured


def cluster(vectors: DataFrame, *args, **kwargs) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector; arguments as of ``assign``."""
    found, centroids, _ = assign(vectors, *args, **kwargs)
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row for each cluster
    hashed = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of_cluster = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster")) if values else F.lit(None).cast(kind)
    inertia = of_cluster([min(sums.get(j, 0), LONGEST) for j in range(len(centroids))], "long")
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance", inertia.alias("cluster_inertia"), F.lit(min(sum(sums.values()), LONGEST)).cast("long").alias("inertia"), of_cluster(hashed, "string").alias("centroid_sha256")
    )
