"""Near-duplicate documents by min-max hashing: both ends of every permutation are kept, so each hash gives two values.

A document's set is its distinct 5-word shingles (64-bit hashes). ``N_PERMUTATIONS`` linear permutations of the hashes give
twice as many values, the minima and the maxima; each is equal in two documents with their Jaccard similarity as
probability, and a minimum and a maximum of one permutation are nearly independent, so the share of equal values is an
unbiased estimate with the variance of twice as many plain min-hashes. Four values make one band. The steps:

1. documents with equal sets become one class, named by its smallest doc_id; only classes go on;
2. a bucket (documents with an equal band) names its smallest member as pivot; every class is checked on the full sets
   against the pivot that it resembles most, and links merge classes into first components;
3. buckets that still hold two or more components are cut into blocks, and pairs of blocks are compared in tasks by their
   signatures: pairs inside one component are skipped, pairs whose estimate reaches ``ESTIMATE_CUT`` are checked on the
   full sets. No list of all pairs is ever made, and no bucket is capped.

Links are thus exact (none that the full sets do not confirm). No band has both ends of one permutation, which in sets of a few
members are not independent. A link between two documents of similarity 0.75 is missed by all bands with a probability below
6e-6; one that only step 3 could find is under the cut with one of 1e-4. A test measures both over all similarities from 0.75 on.

Only one row of each class carries its signature, and what is joined is written before, so that both sides of a join are plain
exchanges: adaptive execution then splits the partition of a hot class, bucket or pivot. A hot bucket that stays mixed costs
comparisons of all its pairs of different components, spread over many tasks; each of its members goes to n / ``BLOCK`` tasks.

Null or empty texts and texts without words have an empty set and are linked with nothing. A doc_id names one text: repeated
rows of it change nothing; if it names several texts, one of them (the least) is compared for it. Rows with a null doc_id are
returned with a null component and class and kept = true. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm import textkernel as K
from terravane.llm.graph import components
from terravane.llm.shared import batches, drop, stored

SHINGLE_WORDS = 5
N_PERMUTATIONS = 256
N_BANDS = 32
BAND_VALUES = 4
BANDED = N_BANDS * BAND_VALUES
SIGNATURE_BYTES = 2 * BANDED + (2 * N_PERMUTATIONS - BANDED)
#: Signature estimates below this are not checked on the full sets (3.6 standard deviations below 0.75).
ESTIMATE_CUT = 0.68
#: The same for a class and its best pivot: one pair for a class, so the cut can be far lower.
PIVOT_CUT = 0.5
BLOCK = 1024
HUB_SALTS = 32

_rng = np.random.default_rng(77)
_A = _rng.integers(1, 2**63, N_PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, N_PERMUTATIONS, dtype=np.uint64)


def _document_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = K.words_of(column)
    row, hashes, _ = K.shingles(w, K.word_hashes(w), SHINGLE_WORDS)
    return K.distinct_sets(row, hashes, len(column))


def min_max_signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """n rows of SIGNATURE_BYTES: for each permutation the minimum and the maximum, of 16 bits in the banded values and 8 in the rest; empty sets: zeros.

    The minima of the banded permutations come first, then their maxima, so that a band has one end only.
    """
    full = np.flatnonzero(np.diff(first) > 0)
    n = len(first) - 1
    banded, rest = np.zeros((n, BANDED), dtype=np.uint16), np.zeros((n, 2 * N_PERMUTATIONS - BANDED), dtype=np.uint8)
    if len(full):
        starts = first[:-1][full]
        for k in range(N_PERMUTATIONS):
            h = values * _A[k] + _B[k]
            both = (k, BANDED // 2 + k) if k < BANDED // 2 else (2 * k, 2 * k + 1)
            for j, end in zip(both, (np.minimum, np.maximum), strict=True):
                # the extremes decide, their mixed bits are the value: near ends alone would share their leading bits
                value = K.mix(end.reduceat(h, starts))
                if j < BANDED:
                    banded[full, j] = (value >> np.uint64(48)).astype(np.uint16)
                else:
                    rest[full, j - BANDED] = (value >> np.uint64(56)).astype(np.uint8)
    return np.concatenate([banded.view(np.uint8), rest], axis=1)


def _signature_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), SIGNATURE_BYTES)


def _equal_share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal values of signatures, row by row."""
    equal = (np.ascontiguousarray(a[:, : 2 * BANDED]).view(np.uint16) == np.ascontiguousarray(b[:, : 2 * BANDED]).view(np.uint16)).sum(1)
    return (equal + (a[:, 2 * BANDED :] == b[:, 2 * BANDED :]).sum(1)) / (2 * N_PERMUTATIONS)


def _binary(matrix: np.ndarray) -> pa.Array:
    width = matrix.dtype.itemsize * matrix.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(matrix), [None, pa.py_buffer(np.ascontiguousarray(matrix))]).cast(pa.binary())


def _signatures(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i, j in K.slices(batch.column(1)):
            part = batch.slice(i, j - i)
            values, first = _document_sets(part.column(1))
            n = np.diff(first)
            # a set's digest: sums of two mixes of its members, and its size
            sums = [K.segment_reduce(np.add, K.mix(values + np.uint64(c)), first, np.uint64(0)) for c in (0x5151, 0xA7A7)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), _binary(min_max_signatures(values, first))],
                names=["doc_id", "n_shingles", "d1", "d2", "sig"],
            )


def _band_keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, sig) to the 32 bucket keys of each class."""
    width = BAND_VALUES * 2
    salt = (np.arange(N_BANDS, dtype=np.uint64) * K.STEP)[None, :]
    for batch in it:
        sig = _signature_rows(batch.column(1))
        keys = K.mix(np.ascontiguousarray(sig[:, : N_BANDS * width]).view(np.uint64) + salt).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), N_BANDS)), pa.array(keys.ravel())], names=["rep", "bucket"])


def _estimates(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        share = _equal_share(_signature_rows(batch.column(2)), _signature_rows(batch.column(3)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], names=["rep", "pivot", "estimate"])


def _runs(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in it:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and tuple(c[0] for c in cols) != last
        last = tuple(c[-1] for c in cols)
        cuts = [0, *np.flatnonzero(change), batch.num_rows]
        for n, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if (n or change[0]) and held:
                yield pa.Table.from_batches(held)
                held = []
            if j > i:
                held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _tile_pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tile (two blocks of a bucket): pairs of different components with a high estimate, where the bucket's band is the first one that they share."""
    width = BAND_VALUES * 2
    salt = (np.arange(N_BANDS, dtype=np.uint64) * K.STEP)[None, :]
    for t in _runs(it, ["bucket", "ti", "tj"]):
        rep, comp, block = (np.asarray(t.column(c)) for c in ("rep", "component", "block"))
        sig = _signature_rows(t.column("sig"))
        ti, tj, bucket = t.column("ti")[0].as_py(), t.column("tj")[0].as_py(), t.column("bucket")[0].as_py()
        left, right = np.flatnonzero(block == ti), np.flatnonzero(block == tj)
        keys = K.mix(np.ascontiguousarray(sig[:, : N_BANDS * width]).view(np.uint64) + salt)
        band = int(np.flatnonzero(keys[0].view(np.int64) == bucket)[0])
        found_a, found_b = [], []
        for i in range(0, len(left), 64):
            x = left[i : i + 64]
            for j in range(0, len(right), 256):
                y = right[j : j + 256]
                ok = comp[x][:, None] != comp[y][None, :]
                if ti == tj:
                    ok &= rep[x][:, None] < rep[y][None, :]
                p, q = np.nonzero(ok)
                for k in range(0, len(p), 2048):
                    a, b = x[p[k : k + 2048]], y[q[k : k + 2048]]
                    near = _equal_share(sig[a], sig[b]) >= ESTIMATE_CUT
                    a, b = a[near], b[near]
                    first = (keys[a] == keys[b]).argmax(1) == band
                    found_a.append(rep[a[first]])
                    found_b.append(rep[b[first]])
        if found_a and sum(map(len, found_a)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], names=["a", "b"])


def _verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, salt, other, text), a hub's own text first (other null): links by 100 * intersection >= 75 * union of the full sets."""
    hub_key, hub_set = None, np.zeros(0, np.uint64)
    for batch in it:
        for i, j in K.slices(batch.column(3)):
            part = batch.slice(i, j - i)
            values, first = _document_sets(part.column(3))
            hubs, salts, others = (part.column(k).to_pylist() for k in range(3))
            out_a, out_b = [], []
            for k in range(part.num_rows):
                own = values[first[k] : first[k + 1]]
                if others[k] is None:
                    hub_key, hub_set = (hubs[k], salts[k]), own
                elif hub_key == (hubs[k], salts[k]):
                    a, b = len(hub_set), len(own)
                    if 100 * min(a, b) < 75 * max(a, b):
                        continue
                    at = np.searchsorted(hub_set, own)
                    at[at == a] = 0
                    both = int((hub_set[at] == own).sum()) if a else 0
                    if both and 100 * both >= 75 * (a + b - both):
                        out_a.append(hubs[k])
                        out_b.append(others[k])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that the full sets of ``texts`` (rep, text) confirm. A hub's text goes to at most HUB_SALTS places, every other text along with its pair."""
    salted = pairs.select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.lit(HUB_SALTS)).cast("int").alias("salt"), F.col("b").alias("other"))
    wanted = salted.select("hub", "salt", "other", F.col("other").alias("rep")).union(
        salted.select("hub", "salt").distinct().select("hub", "salt", F.lit(None).cast("long").alias("other"), F.col("hub").alias("rep"))
    )
    rows = wanted.hint("merge").join(texts.hint("merge"), "rep").select("hub", "salt", "other", "text")
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = rows.repartition(int(n), "hub", "salt").sortWithinPartitions("hub", "salt", F.col("other").asc_nulls_first())
    return rows.mapInArrow(_verify, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach), kept, class_id (smallest doc_id with the same set), for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stored(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, d1 long, d2 long, sig binary"), "sets")
    keys = ["n_shingles", "d1", "d2"]
    # equal sets have equal signatures
    classes = sets.where("n_shingles > 0 and doc_id is not null").groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    classes = stored(classes, "classes")
    members = sets.select("doc_id", *keys).hint("merge").join(classes.select(*keys, "rep").hint("merge"), keys, "left")
    reps = stored(classes.groupBy("rep").agg(F.min("sig").alias("sig")), "reps")

    banded = stored(reps.mapInArrow(_band_keys, "rep long, bucket long"), "bands")
    buckets = stored(banded.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("top")).where("pivot < top").select("bucket", "pivot"), "pivots")
    banded_in = stored(banded.hint("merge").join(buckets.hint("merge"), "bucket"), "buckets")
    drop(banded, buckets)
    in_buckets = stored(reps.hint("merge").join(banded_in.select("rep").distinct().hint("merge"), "rep", "left_semi"), "reps")

    to_pivot = banded_in.where("rep <> pivot").select("rep", "pivot").distinct()
    sig_of = lambda name: in_buckets.select(F.col("rep").alias(name), F.col("sig").alias(f"{name}_sig")).hint("merge")
    scored = to_pivot.hint("merge").join(sig_of("rep"), "rep").join(sig_of("pivot"), "pivot").select("rep", "pivot", "rep_sig", "pivot_sig")
    scored = scored.mapInArrow(_estimates, "rep long, pivot long, estimate double").where(F.col("estimate") >= PIVOT_CUT)
    best = stored(scored.groupBy("rep").agg(F.max(F.struct("estimate", (-F.col("pivot")).alias("low"))).alias("m")).select((-F.col("m.low")).alias("a"), F.col("rep").alias("b")), "pivots")

    texts = stored(docs.hint("merge").join(in_buckets.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("rep")).agg(F.min("text").alias("text")), "texts")
    links_1 = stored(_confirmed(best, texts), "links")
    first = components(links_1)

    labelled = banded_in.select("bucket", "rep").hint("merge").join(first.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    labelled = stored(labelled, "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    # a class has at most N_BANDS buckets: with them in one array, its signature is joined once
    mixed = stored(mixed, "mixed")
    blocked = labelled.hint("merge").join(mixed.hint("merge"), "bucket").groupBy("rep", "component").agg(F.collect_list(F.struct("bucket", "blocks")).alias("at"))
    blocked = blocked.hint("merge").join(in_buckets.hint("merge"), "rep").withColumn("at", F.explode("at")).select("rep", "component", "sig", "at.*")
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    tiled = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"), "rep", "component", "block", "sig")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = stored(tiled.repartition(n, "bucket", "ti", "tj").sortWithinPartitions("bucket", "ti", "tj").mapInArrow(_tile_pairs, "a long, b long"), "pairs")
    links = links_1.union(_confirmed(pairs, texts))
    final = components(links)
    drop(labelled, mixed, pairs, links_1, banded_in, best, reps, in_buckets, texts)

    out = members.hint("merge").join(final.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left")
    named = lambda *c: F.when(F.col("doc_id").isNotNull(), F.coalesce(*c, "doc_id"))
    out = out.select("doc_id", "n_shingles", named("component", "rep").alias("component_id"), named("rep").alias("class_id"))
    out = out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")
    found = stored(out, "near-duplicates")  # so that the signatures can go
    drop(sets, classes, first, final)
    return found
