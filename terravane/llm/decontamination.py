"""Benchmark passages in whole texts, by greedy string tiling.

Words are runs of ASCII letters and digits and of all non-ASCII characters, with A-Z in lower case. Karp-Rabin hashes (64 bits)
of all windows of ``MIN_MATCH`` words are the seeds: a text and a test item are compared if they share one. Equal windows on one
diagonal make longer matches. Tiling marks the longest match whose words are all free in both, again and again; a match that
runs into marked words is cut and goes back in line. Tiles don't overlap and may stand in any order, so passages that were
rearranged are covered as well. A text is contaminated by an item if the tiles cover ``COVERAGE`` of the item's words.

An item of fewer than MIN_MATCH words is found where its whole word sequence stands; one without words is never found.

Windows that more than ``COMMON`` items have don't all seed: of an item's, the most common ones may go as long as the words that
they stand on, wherever they are repeated in it, are fewer than COVERAGE of its words. Tiles of the others are then needed to reach
COVERAGE, so no contaminating item is ever missed. ``best_item`` and ``coverage`` are those of the items that share a seed.

Items of up to ``BROADCAST_BYTES`` of text in all are broadcast, and each text is tiled where it is read. A larger benchmark is
joined: the seeds of both sides meet by a shuffle (a bitmap of the items' seeds of at most ``BITMAP_SLOTS`` words keeps other
windows of the texts at home), which gives the pairs to tile; a text is sent once for each ``SALTS``-th of its items. Both ways
have the same seeds, and give the same results.

Null or empty texts are clean, and so is everything if there are no items. Repeated rows are each answered. Repeated item_ids
count as items of their own. ``keep`` names the columns that are passed through, by any names but the results'; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terravane.llm import textkernel as K
from terravane.llm.shared import batches, drop, stored

MIN_MATCH = 5
COVERAGE = 0.5
BROADCAST_BYTES = 8_000_000
COMMON, SALTS = 64, 16
#: Words of 64 bits that the bitmap of a large benchmark has at most.
BITMAP_SLOTS = 1 << 21
#: Equal windows that are held at a time; beyond that, texts and then items are taken one by one.
MOST_MATCHES = 4_000_000
_BITS = 22


class Windows:
    """Windows of ``size`` words of those items that ``of`` names, sorted by hash."""

    def __init__(self, w: K.Words, hashes: np.ndarray, size: int, of: np.ndarray):
        item, key, at = K.shingles(w, hashes, size, short=False)
        own = of[item]
        item, key, at = item[own], key[own], at[own]
        order = np.argsort(key, kind="stable")
        self.keys, self.item, self.at = key[order], item[order], (at - w.first[item])[order]
        self.shift = np.uint64(64 - min(_BITS, 8 + len(self.keys).bit_length()))
        self.marked = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.marked[self.keys >> self.shift] = True

    def seeding(self, n_words: np.ndarray, common: int) -> np.ndarray:
        """Whether each window seeds: all but the most common ones of an item, as far as they stand on fewer than COVERAGE of its words."""
        pair = np.lexsort((self.keys, self.item))
        item, key = self.item[pair], self.keys[pair]
        new = np.ones(len(pair), dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (key[1:] != key[:-1])
        at = np.flatnonzero(new)
        times = np.diff([*at, len(pair)])
        _, of, items = np.unique(key[at], return_inverse=True, return_counts=True)
        items = items[of]
        often = np.flatnonzero(items > common)
        often = often[np.lexsort((key[at][often].view(np.int64), -items[often], item[at][often]))]
        own = item[at][often]
        stands = np.cumsum(times[often] * MIN_MATCH)
        first = np.searchsorted(own, own)  # of the same item
        before = np.concatenate([[0], stands])[first]
        keeps = np.ones(len(at), dtype=bool)
        keeps[often] = stands - before >= COVERAGE * n_words[own]
        out = np.empty(len(pair), dtype=bool)
        out[pair] = np.repeat(keeps, times)
        return out

    def count(self, keys: np.ndarray) -> int:
        some = keys[self.marked[keys >> self.shift]]
        return int((np.searchsorted(self.keys, some, side="right") - np.searchsorted(self.keys, some)).sum())

    def matches(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``keys``, window of the block) of all equal windows."""
        some = np.flatnonzero(self.marked[keys >> self.shift])
        lo, hi = np.searchsorted(self.keys, keys[some]), np.searchsorted(self.keys, keys[some], side="right")
        n = hi - lo
        where = np.repeat(some, n)
        return where, np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(where))

    def items_in(self, row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of all equal windows; a window that a row repeats counts once."""
        some = np.flatnonzero(self.marked[keys >> self.shift])
        row, keys = row[some], keys[some]
        order = np.lexsort((keys, row))
        row, keys = row[order], keys[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
        where, window = self.matches(keys[new])
        return row[new][where], self.item[window]


class Items:
    """Word hashes and windows of a block of test items; short items are windows of their own length."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        w = K.words_of(pa.array(texts, pa.string()), K.ALNUM)
        hashes = K.word_hashes(w)
        self.ids = np.array([-1 if x is None else x for x in ids], dtype=np.int64)
        self.n_words = np.diff(w.first)
        self.windows = Windows(w, hashes, MIN_MATCH, self.n_words >= MIN_MATCH)
        self.seeds = self.windows.seeding(self.n_words, COMMON)
        self.short = {n: Windows(w, hashes, n, self.n_words == n) for n in range(1, MIN_MATCH) if (self.n_words == n).any()}


def runs(p: np.ndarray, q: np.ndarray, size: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """The longest matches (minus length, start in the item, start in the text) of the equal windows (p[k], q[k]) of ``size`` words."""
    order = np.lexsort((q, p - q))
    p, q = p[order], q[order]
    breaks = np.flatnonzero((np.diff(p - q) != 0) | (np.diff(q) != 1)) + 1
    return [(-(b - a + size - 1), int(q[a]), int(p[a])) for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(p)])]


def walked_runs(text: np.ndarray, item: np.ndarray, size: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """The same from the windows' keys of a text and an item, window by window of the item: what is held is one window's places."""
    order = np.argsort(text, kind="stable")
    keys = text[order]
    line: list[tuple[int, int, int]] = []
    places, begun = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for q in range(len(item) + 1):
        if q < len(item):
            lo, hi = np.searchsorted(keys, item[q]), np.searchsorted(keys, item[q], side="right")
            here = np.sort(order[lo:hi])
        else:
            here = np.zeros(0, np.int64)
        ended = ~np.isin(places + 1, here, assume_unique=True)
        line += [(-(q - b + size - 1), b, x - (q - 1 - b)) for x, b in zip(places[ended].tolist(), begun[ended].tolist(), strict=True)]
        start = np.full(len(here), q)
        at = np.searchsorted(places, here - 1)
        goes_on = at < len(places)
        goes_on[goes_on] = places[at[goes_on]] == here[goes_on] - 1
        start[goes_on] = begun[at[goes_on]]
        places, begun = here, start
    return line


def tiles(p: np.ndarray, q: np.ndarray, size: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in the text, start in the item, length) from the equal windows (p[k], q[k]) of ``size`` words."""
    return tiled(runs(p, q, size), size)


def tiled(line: list[tuple[int, int, int]], size: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles from the longest matches of ``runs``."""
    heapq.heapify(line)
    in_text: set[int] = set()
    in_item: set[int] = set()
    found = []
    while line:
        length, y, x = heapq.heappop(line)
        length = -length
        free = [x + k not in in_text and y + k not in in_item for k in range(length)]
        if all(free):
            found.append((x, y, length))
            in_text.update(range(x, x + length))
            in_item.update(range(y, y + length))
            continue
        k = 0
        while k < length:  # the free stretches go back in line
            if not free[k]:
                k += 1
                continue
            e = k
            while e < length and free[e]:
                e += 1
            if e - k >= size:
                heapq.heappush(line, (-(e - k), y + k, x + k))
            k = e
    return found


def _shares(row: np.ndarray, key: np.ndarray, at: np.ndarray, items: Items) -> dict[tuple[int, int], float]:
    """Covered share of each (row, item) that share a seed, from the windows of some texts in order of their rows."""
    windows = items.windows
    shares: dict[tuple[int, int], float] = {}
    if windows.count(key) <= MOST_MATCHES:
        where, window = windows.matches(key)
        n = len(items.ids) + 1
        pair = row[where] * n + windows.item[window]
        order = np.argsort(pair, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1) if len(order) else []:
            r, item = divmod(int(pair[group[0]]), n)
            if items.seeds[window[group]].any():
                shares[r, item] = sum(t[2] for t in tiles(at[where[group]], windows.at[window[group]])) / int(items.n_words[item])
        return shares
    rows = np.unique(row)
    if len(rows) > 1:
        middle = int(np.searchsorted(row, rows[len(rows) // 2]))
        return _shares(row[:middle], key[:middle], at[:middle], items) | _shares(row[middle:], key[middle:], at[middle:], items)
    _, window = windows.matches(np.unique(key))
    for item in np.unique(windows.item[window[items.seeds[window]]]).tolist():
        own = windows.item == item
        order = np.argsort(windows.at[own])
        shares[int(rows[0]), item] = sum(t[2] for t in tiled(walked_runs(key, windows.keys[own][order]))) / int(items.n_words[item])
    return shares


def _found(it: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """Columns: any, and the text last; out go the columns without it, and best_item, coverage and items."""
    for batch in it:
        at_text = batch.num_columns - 1
        for i, j in K.slices(batch.column(at_text)):
            part = batch.slice(i, j - i)
            w = K.words_of(part.column(at_text), K.ALNUM)
            hashes = K.word_hashes(w)
            shares = _shares(*K.shingles(w, hashes, MIN_MATCH, short=False), items)
            for size, short in items.short.items():
                row, key, _ = K.shingles(w, hashes, size, short=False)
                row, item = short.items_in(row, key)
                shares |= dict.fromkeys(zip(row.tolist(), item.tolist(), strict=True), 1.0)
            best: list[int | None] = [None] * (j - i)
            coverage, hits = [0.0] * (j - i), [[] for _ in range(j - i)]
            for (r, item), covered in sorted(shares.items()):
                if covered > coverage[r]:
                    coverage[r], best[r] = covered, int(items.ids[item])
                if covered >= COVERAGE:
                    hits[r].append(int(items.ids[item]))
            found = [pa.array(best, pa.int64()), pa.array(coverage, pa.float64()), pa.array(hits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(at_text)), *found], names=[*part.schema.names[:at_text], "best_item", "coverage", "items"])


_RESULTS = "best_item long, coverage double, items array<long>"


def _by_broadcast(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``rows`` (any columns, the text last) with the results in its place; ``items`` (item_id, text) are checked to be small."""
    own = items.orderBy("item_id", "text").collect()
    shared = rows.sparkSession.sparkContext.broadcast(Items([r["item_id"] for r in own], [r["text"] for r in own]))
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL(_RESULTS).fields])
    return rows.mapInArrow(lambda it: _found(it, shared.value), schema)


def _item_seeds(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) to (key, item, n_words, times): windows of MIN_MATCH words, or a shorter item's whole sequence; a repeated one once, with how often it stands there."""
    for batch in it:
        for i, j in K.slices(batch.column(1)):
            part = batch.slice(i, j - i)
            w = K.words_of(part.column(1), K.ALNUM)
            row, key, _ = K.shingles(w, K.word_hashes(w), MIN_MATCH)
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            new = np.ones(len(row), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            at = np.flatnonzero(new)
            of = row[at]
            columns = [pa.array(key[at].view(np.int64)), part.column(0).take(pa.array(of)), pa.array(np.diff(w.first)[of]), pa.array(np.diff([*at, len(row)]).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "item", "n_words", "times"])


def _text_seeds(it: Iterator[pa.RecordBatch], bitmap: np.ndarray, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """(row, text) to the (key, row) that the bitmap lets through; ``sizes``: words of the short items, whose keys are those of texts with so many words."""
    for batch in it:
        for i, j in K.slices(batch.column(1)):
            w = K.words_of(batch.column(1).slice(i, j - i), K.ALNUM)
            hashes = K.word_hashes(w)
            for size in (*sizes, MIN_MATCH):
                row, key = _runs_of(w, hashes, size)
                there = (bitmap[key >> np.uint64(6) & np.uint64(len(bitmap) - 1)] >> (key & np.uint64(63))) & np.uint64(1) == 1
                values, first = K.distinct_sets(row[there], key[there], j - i)
                rows = batch.column(0).slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), np.diff(first))))
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), rows], names=["key", "row"])


def _runs_of(w: K.Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all runs of ``size`` words; with fewer than MIN_MATCH, keys as of a whole sequence of that length."""
    if size == MIN_MATCH:
        return K.shingles(w, hashes, size, short=False)[:2]
    row, _, at = K.shingles(w, hashes, size, short=False)
    start = w.start[at], w.start[at]
    few = K.Words(w.data, *start, np.repeat(np.arange(len(at)), size), np.arange(len(at) + 1) * size, np.arange(len(at) + 1))
    return row, K.shingles(few, hashes[at[:, None] + np.arange(size)].ravel(), MIN_MATCH)[1]


class _Text:
    """A text's windows in order and sorted by key, and the keys of its runs of fewer words."""

    def __init__(self, keys: np.ndarray, short: dict[int, np.ndarray]):
        self.keys, self.short = keys, short
        self.order = np.argsort(keys, kind="stable")
        self.sorted = keys[self.order]

    def share(self, item: np.ndarray, n_words: int) -> float:
        """The share of an item's words that tiles cover, from the keys of its windows in order, or of its whole sequence if that is shorter."""
        if n_words < MIN_MATCH:
            return float(bool(n_words) and bool((self.short[n_words] == item[0]).any()))
        lo, hi = np.searchsorted(self.sorted, item), np.searchsorted(self.sorted, item, side="right")
        n = hi - lo
        if n.sum() > MOST_MATCHES:
            found = tiled(walked_runs(self.keys, item))
        elif n.any():
            place = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            found = tiles(self.order[place], np.repeat(np.arange(len(item)), n))
        else:
            return 0.0
        return sum(t[2] for t in found) / n_words


def _tile_pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, salt, item_id, item, text), a text first (its item number null), then its items: (row, item_id, share) of each."""
    now, text = None, None
    for batch in it:
        for i, j in K.slices(batch.column(4)):
            part = batch.slice(i, j - i)
            w = K.words_of(part.column(4), K.ALNUM)
            hashes = K.word_hashes(w)
            of, key, at = K.shingles(w, hashes, MIN_MATCH)
            order = np.lexsort((at, of))
            of, key = of[order], key[order]
            first = np.searchsorted(of, np.arange(len(part) + 1))
            n_words = np.diff(w.first)
            runs_ = {n: _runs_of(w, hashes, n) for n in range(1, MIN_MATCH)}
            runs_first = {n: np.searchsorted(r[0], np.arange(len(part) + 1)) for n, r in runs_.items()}
            rows, salts, items = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist()
            shares, pairs = [], []
            for k in range(len(part)):
                own = key[first[k] : first[k + 1]]
                if items[k] is None:
                    now = rows[k], salts[k]
                    text = _Text(own if n_words[k] >= MIN_MATCH else own[:0], {n: r[1][runs_first[n][k] : runs_first[n][k + 1]] for n, r in runs_.items()})
                elif now == (rows[k], salts[k]):
                    pairs.append(k)
                    shares.append(text.share(own, int(n_words[k])))
            of_pairs = part.take(pa.array(pairs, pa.int64()))
            yield pa.RecordBatch.from_arrays([of_pairs.column(0), of_pairs.column(2), pa.array(shares, pa.float64())], names=["row", "item_id", "share"])


def _by_join(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The same for a benchmark of any size."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = rows.columns[:-1]
    rows = stored(rows.select(F.monotonically_increasing_id().alias("__row"), *rows.columns), "rows")
    items = stored(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    seeds = stored(items.select("item", "text").mapInArrow(_item_seeds, "key long, item long, n_words long, times long"), "item-seeds")
    # as in Windows.seeding: the most common windows of an item may go while they stand on fewer than COVERAGE of its words
    common = seeds.groupBy("key").agg(F.count("*").alias("items")).where(F.col("items") > COMMON)
    common = stored(common, "common")
    ranked = seeds.hint("merge").join(common.hint("merge"), "key", "left")
    w = Window.partitionBy("item").orderBy(F.desc_nulls_last("items"), "key").rowsBetween(Window.unboundedPreceding, 0)
    stands = F.sum(F.when(F.col("items").isNotNull(), F.col("times") * MIN_MATCH)).over(w)
    keeps = F.col("items").isNull() | (F.col("stands") >= F.col("n_words") * COVERAGE)
    seeds_kept = stored(ranked.withColumn("stands", stands).where(keeps).select("key", "item", "n_words"), "seeds")
    slots = min(BITMAP_SLOTS, 1 << max(6, (seeds_kept.count() // 4).bit_length()))
    slot = F.shiftrightunsigned("key", 6).bitwiseAND(F.lit(slots - 1))
    words = seeds_kept.groupBy(slot.alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(key & 63 AS INT))")).alias("bits")).toArrow()  # at most BITMAP_SLOTS rows of two numbers
    bitmap = np.zeros(slots, dtype=np.uint64)
    bitmap[np.asarray(words.column("slot").combine_chunks())] = np.asarray(words.column("bits").combine_chunks()).view(np.uint64)
    sizes = sorted(r["n_words"] for r in seeds_kept.where(F.col("n_words") < MIN_MATCH).select("n_words").distinct().collect())  # at most MIN_MATCH
    shared = spark.sparkContext.broadcast(bitmap)
    windows = stored(rows.select("__row", "__text").mapInArrow(lambda it: _text_seeds(it, shared.value, sizes), "key long, row long"), "windows")
    pairs = stored(windows.hint("merge").join(seeds_kept.select("key", "item").hint("merge"), "key").select("row", "item").distinct(), "pairs")
    salted = pairs.select("row", F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int").alias("salt"), "item")
    texts = salted.select("row", "salt").distinct().hint("merge").join(rows.select(F.col("__row").alias("row"), F.col("__text").alias("text")).hint("merge"), "row")
    of_items = salted.hint("merge").join(items.hint("merge"), "item").select("row", "salt", "item_id", "item", "text")
    both = of_items.unionByName(texts.select("row", "salt", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("long").alias("item"), "text"))
    both = both.repartition(n, "row", "salt").sortWithinPartitions("row", "salt", F.col("item").asc_nulls_first())
    shares = stored(both.mapInArrow(_tile_pairs, "row long, item_id long, share double").where("share > 0"), "shares")
    best = F.min(F.struct((-F.col("share")).alias("less"), F.coalesce("item_id", F.lit(-1)).alias("item_id")))
    hits = F.sort_array(F.collect_list(F.when(F.col("share") >= COVERAGE, F.coalesce("item_id", F.lit(-1)))))
    found = shares.groupBy(F.col("row").alias("__row")).agg(best.alias("b"), hits.alias("items"))
    found = found.select("__row", F.col("b.item_id").alias("best_item"), (-F.col("b.less")).alias("coverage"), "items")
    drop(seeds, common, seeds_kept, windows, pairs)
    out = rows.drop("__text").hint("merge").join(found.hint("merge"), "__row", "left")
    return out.select(*names, "best_item", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("items", F.array().cast("array<long>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, with best_item, coverage (0 to 1 of that item's words), items (all that contaminate) and contaminated."""
    batches(docs)
    # the caller's columns are numbered on the way, so that their names can't clash with these
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("__text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    found = (_by_broadcast if total <= BROADCAST_BYTES else _by_join)(rows, items)
    return found.select(*[F.col(f"__{k}").alias(c) for k, c in enumerate(keep)], "best_item", "coverage", "items", (F.size("items") > 0).alias("contaminated"))
