"""Children of a key as arrays, in numbered blocks of a bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.operators.store import kept

#: Items of a block, at most.
BLOCK = 10_000


def in_blocks(rows: DataFrame, key: str, order: Sequence[str], into: str, most: int = BLOCK) -> DataFrame:
    """(key, block, into): the other columns of ``rows`` as structs in arrays sorted by ``order``: ``most`` items in each of a key's blocks, which are numbered from 0, and the rest in its last.

    Keys of more than ``most`` items are counted out first. Theirs are stored in ranges of (key, order), so that a key with a large share of all
    rows goes to many tasks, and no task or row holds all of it: a row's place in its key is that in its range plus a running sum over
    the key's ranges. The items of other keys are one block, gathered at once.
    """
    rest = [c for c in rows.columns if c != key and c not in order]
    gathered = F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(into)
    large = kept(rows.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select("__k"), "large-keys")
    few, many = rows, None
    if not large.isEmpty():
        same = F.col(key).eqNullSafe(F.col("__k"))
        few = rows.hint("merge").join(large.hint("merge"), same, "left_anti")
        many = rows.hint("merge").join(large.hint("merge"), same, "left_semi")
    small = few.groupBy(key).agg(gathered).select(key, F.lit(0).alias("block"), into)
    return small if many is None else small.unionByName(_ranged(many, key, order, rest, gathered, most))


def _ranged(rows: DataFrame, key: str, order: Sequence[str], rest: Sequence[str], gathered: Column, most: int) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(rows.repartitionByRange(n, key, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(key, "__range").agg(F.count("*").alias("__n"))  # a row for each range of a key
    before = (F.sum("__n").over(Window.partitionBy(key).orderBy("__range")) - F.col("__n")).alias("__before")
    offsets = kept(counts.select(F.col(key).alias("__k"), F.col("__range").alias("__r"), before), "offsets")
    place = F.row_number().over(Window.partitionBy(key, "__range").orderBy(*order, *rest)) - 1
    same = F.col(key).eqNullSafe(F.col("__k")) & (F.col("__range") == F.col("__r"))
    placed = ranged.withColumn("__place", place).hint("merge").join(offsets.hint("merge"), same)
    blocks = placed.withColumn("block", F.floor((F.col("__before") + F.col("__place")) / most).cast("int"))
    return blocks.groupBy(key, "block").agg(gathered)
