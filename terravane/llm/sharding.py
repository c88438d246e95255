"""Shards of near equal bytes by histogram sort: splitters are found by counting, then every row is exchanged once.

Rows are ordered by (key, tie): the key is ``doc_id`` and the tie a hash of the text. The first round lays evenly spaced
probes over the key's range and counts exact bytes and rows between them in one aggregation; each later round lays probes
only inside the intervals that still hold a splitter, until the bytes below every splitter are within the tolerance of its
target or the interval is a single key; all such keys are then refined together in the same way over the tie. A shard is made of
parts, further splitter intervals, each of which goes to a task of its own (``repartitionById``), so that numbering a shard's
rows is the work of many tasks; the exact counts of rows below each splitter turn numbers within a part into gapless slots.

Only DataFrame functions run. There are at most ``MOST_PARTS`` parts, so what the driver sees is bounded whatever the data's size:
2^FIRST_BITS counts in the first round, then 2^ROUND_BITS for each splitter; the splitters are one literal of the plan. Up to
``PART_BYTES`` times ``MOST_PARTS`` bytes a part has PART_BYTES; beyond that parts grow, and their tasks sort with spilling.

Size of a row: UTF-8 bytes of its text (null: none) plus 1. Rows with a null key come first. Rows that are equal in key and
text are interchangeable and stay in one part. An empty table gives no rows. Columns named like an output are replaced; other
columns may have any names.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.llm.shared import drop, stored

N_SHARDS = 8
#: Bytes that a part should have, and how far a splitter may be from its target, as a share of a part's bytes.
PART_BYTES = 32_000_000
MOST_PARTS = 16_384
TOLERANCE = 0.002
#: A key with several rows is split over the tie if it has more than this share of a part's bytes.
HEAVY_KEY = 0.02
#: Intervals of the first round, and inside each unfinished interval of a later one, as powers of two.
FIRST_BITS, ROUND_BITS = 12, 6
LOWEST = -(2**63)


@dataclass(frozen=True)
class Splitter:
    """The first (key, tie) of a part, and what lies below it."""

    key: int
    tie: int
    bytes: int
    rows: int


def _position(key: Column, tie: Column, cuts: list[Splitter]) -> Column:
    """How many of the sorted ``cuts`` are not above (key, tie): comparisons where they are few, else a binary search over a literal."""
    if len(cuts) <= 40:  # a chain of comparisons stays in generated code
        return sum((F.when((key > c.key) | ((key == c.key) & (tie >= c.tie)), 1).otherwise(0) for c in cuts), F.lit(0))
    keys, ties = (_longs([getattr(c, of) for c in cuts]) for of in ("key", "tie"))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        k, t = F.get(keys, mid), F.get(ties, mid)
        right = F.coalesce((k < key) | ((k == key) & (t <= tie)), F.lit(False))
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~right, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), start, halve, lambda s: s["lo"])


def _longs(values: list[int]) -> Column:
    """An array of longs that the optimiser folds into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _refine(rows: DataFrame, group: Column, column: str, low: int, high: int, targets: dict[int, list[int]], tolerance: float) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each group's ascending targets: (bound, bytes below, rows below, bytes of the bound's own value if it has several rows and the target is inside, else 0).

    The bound of ``column`` is the one whose bytes below, in its group, are nearest to the target; low <= values <= high. Probes
    stand at low + k * 2^shift; a round counts between neighbouring probes, in all rows at first, then only in the intervals
    that still hold a target, with a smaller shift.
    """
    if high - low >= 2**63:  # a difference could overflow; flipping the sign bit orders all longs from LOWEST
        low, above = LOWEST, F.col(column).bitwiseXOR(F.lit(LOWEST))
    else:
        above = F.col(column) - F.lit(low)
    signed = lambda c: c - 2**64 if c >= 2**63 else c
    cell = lambda s: F.shiftrightunsigned(above, s) if s else above
    shift = max(0, (high - low + 1).bit_length() - FIRST_BITS)
    # (group, cell of this shift whose inside is unfinished): what lies below it in the group, and the targets in it
    waiting = {(g, 0): (0, 0, list(range(len(t)))) for g, t in targets.items()}
    outer = None
    done: dict[int, dict[int, tuple[int, int, int, int]]] = {g: {} for g in targets}
    rows = rows.select(group.alias("group"), column, "size")
    while waiting:
        inside = rows
        if outer is not None:
            places = json.dumps([{"group": g, "outer": signed(c)} for g, c in sorted(waiting)])  # at most a row for each splitter
            places = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(places), "array<struct<group:long,outer:long>>")))
            inside = rows.withColumn("outer", cell(outer)).join(F.broadcast(places), ["group", "outer"], "left_semi")
        counted = inside.groupBy("group", cell(shift).alias("cell")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        width = 2 ** (outer - shift) if outer is not None else None
        counts: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for g, c, b, n in sorted((r["group"], r["cell"] % 2**64, r["b"], r["n"]) for r in counted):
            counts.setdefault((g, c // width if width else 0), []).append((c, b, n))
        following: dict[tuple[int, int], tuple[int, int, list[int]]] = {}
        for (g, parent), (b, n, which) in waiting.items():
            cells = counts[g, parent]
            at = 0
            for i in which:  # ascending targets
                target = targets[g][i]
                while at < len(cells) - 1 and b + cells[at][1] <= target:
                    b, n, at = b + cells[at][1], n + cells[at][2], at + 1
                c, inside_b, inside_n = cells[at]
                start, end = low + (c << shift), low + ((c + 1) << shift)
                if abs(b - target) <= tolerance:
                    done[g][i] = (start, b, n, 0)
                elif abs(b + inside_b - target) <= tolerance and end <= high:
                    done[g][i] = (end, b + inside_b, n + inside_n, 0)
                elif shift == 0:  # one value: below or above it, whichever is nearer
                    upper = end <= high and b + inside_b - target < target - b
                    inside_rows = inside_b if inside_n > 1 else 0
                    done[g][i] = (end, b + inside_b, n + inside_n, 0) if upper and not inside_rows else (start, b, n, inside_rows)
                else:
                    following.setdefault((g, c), (b, n, []))[2].append(i)
        waiting, outer, shift = following, shift, max(0, shift - ROUND_BITS)
    return {g: [done[g][i] for i in range(len(t))] for g, t in targets.items()}


def splitters(keys: DataFrame, n_parts: int, total: int) -> list[Splitter]:
    """The n_parts - 1 splitters of ``keys`` (key, tie, size)."""
    targets = [total * k // n_parts for k in range(1, n_parts)]
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    tolerance = TOLERANCE * total / n_parts
    found = []
    stuck: dict[int, list[int]] = {}
    for i, (bound, b, n, several) in enumerate(_refine(keys, F.lit(0).cast("long"), "key", low, high, {0: targets}, tolerance)[0]):
        found.append(Splitter(bound, LOWEST, b, n))
        if several > HEAVY_KEY * total / n_parts:
            stuck.setdefault(bound, []).append(i)
    if not stuck:
        return found
    heavy = keys.where(F.array_contains(_longs(sorted(stuck)), F.col("key"))) if len(stuck) <= 40 else keys
    inner = {key: [targets[i] - found[i].bytes for i in which] for key, which in stuck.items()}
    for key, bounds in _refine(heavy, F.col("key"), "tie", LOWEST, 2**63 - 1, inner, tolerance).items():
        for i, (tie, b, n, _) in zip(stuck[key], bounds, strict=True):
            found[i] = Splitter(key, min(tie, 2**63 - 1), found[i].bytes + b, found[i].rows + n)
    return found


def shard(docs: DataFrame, n_shards: int = N_SHARDS, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """All columns of ``docs``, with ``size``, ``shard`` (0 to n_shards - 1) and ``slot`` (the row's place in its shard, gapless from 0)."""
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    order = F.coalesce(F.col(key).cast("long"), F.lit(LOWEST))
    tie = F.xxhash64(text)
    keys = stored(docs.select(order.alias("key"), tie.alias("tie"), size.alias("size")), "keys")
    total = keys.agg(F.sum("size")).first()[0]
    whole = docs.drop("size", "shard", "slot")
    if not total:
        return whole.select("*", size.alias("size"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    parts = max(4, min(-(-total // (n_shards * part_bytes)), MOST_PARTS // n_shards))
    cuts = splitters(keys, n_shards * parts, total)
    drop(keys)

    # the caller's columns travel in one struct, so that their names can't clash with these
    rows = whole.select(F.struct(*[F.col(f"`{c}`") for c in whole.columns]).alias("row"), size.alias("size"), order.alias("key"), tie.alias("tie"))
    rows = rows.withColumn("part", _position(F.col("key"), F.col("tie"), cuts).cast("int")).repartitionById(n_shards * parts, F.col("part"))
    firsts = [0, *(c.rows for c in cuts)]
    base = _longs([firsts[i] - firsts[i // parts * parts] for i in range(len(firsts))])
    at = F.row_number().over(Window.partitionBy("part").orderBy("key", "tie")) - 1
    return rows.withColumn("at", at).select("row.*", "size", F.floor(F.col("part") / parts).cast("int").alias("shard"), (F.get(base, F.col("part")) + F.col("at")).cast("long").alias("slot"))
