"""Ordered scans in ranges: what a row needs of the rows before it, without one task for all rows of a key.

``in_ranges`` lays rows out in stored ranges of (key, order): a key with a large share of all rows goes to many of them. ``with_leads`` puts
a row in front of each range's part of a key, which hands on what the parts before it leave: the last row's values, the last values
that were known, sums. A window over (key, range) then sees what a window over the key would. Leads are worked out from one small row for each range
of a key, so the only window over a key is over these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from terravane.operators.store import kept


def in_ranges(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows``, stored in ranges of the columns ``key`` and ``order`` with the range's number, ``__range``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(rows.repartitionByRange(n, *key, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def with_leads(ranged: DataFrame, key: Sequence[str], order: Sequence[str], last: Sequence[str] = (), known: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """``ranged`` with ``__lead``, and a leading row (``__lead`` true) for each (key, range) behind others of the key.

    A leading row has, of the key's rows in the ranges before, the ``last`` row's values, the last non-null values of the columns
    ``known``, and the ``sums``; other columns are null. The order has to be one without ties where ``last`` or ``known`` are asked for.
    """
    place = F.struct(*order)
    of_range = [F.sum(c).alias(c) for c in sums] + [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in known]
    parts = ranged.groupBy(*key, "__range").agg(F.max_by(F.struct(F.lit(1).alias("one"), *last), place).alias("__last"), *of_range)
    w = Window.partitionBy(*key).orderBy("__range")  # a row for each range of a key
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    handed = [F.sum(c).over(before).alias(c) for c in sums] + [F.last(c, ignorenulls=True).over(before).alias(c) for c in known]
    leads = parts.select(*key, "__range", F.lag("__last").over(w).alias("__last"), *handed).where("__last IS NOT NULL")
    leads = leads.select(*key, "__range", *[F.col(f"__last.{c}").alias(c) for c in last], *known, *sums, F.lit(True).alias("__lead"))
    return ranged.withColumn("__lead", F.lit(False)).unionByName(leads, allowMissingColumns=True)


def along(key: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """The rows of a range's part of a key in order, its leading row first."""
    return Window.partitionBy("__range", *key).orderBy(F.desc("__lead"), *order)


def so_far(key: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """The rows up to each one."""
    return along(key, order).rowsBetween(Window.unboundedPreceding, 0)


def rows_only(scanned: DataFrame) -> DataFrame:
    """The rows without the leading ones."""
    return scanned.where("NOT __lead").drop("__lead")


def steps_from(rows: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """``rows`` with the values of ``columns`` in the row before of the same key, and whether there is one (``has_<prefix>``)."""
    w = along(key, order)
    led = with_leads(in_ranges(rows, key, order), key, order, last=[c for c in columns if c not in key])
    return rows_only(led.select("*", *[F.lag(c).over(w).alias(prefix + c) for c in columns], F.lag(F.lit(True)).over(w).isNotNull().alias(f"has_{prefix}"))).drop("__range")


def running_sum(rows: DataFrame, key: Sequence[str], order: Sequence[str], column: Column, into: str) -> DataFrame:
    """``rows`` with the sum of ``column`` over the key's rows up to each one, that one included."""
    led = with_leads(in_ranges(rows.withColumn(into, column), key, order), key, order, sums=[into])
    return rows_only(led.withColumn(into, F.sum(into).over(so_far(key, order)))).drop("__range")


def last_known(rows: DataFrame, key: Sequence[str], order: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """``rows`` with the last non-null value of each of ``columns`` up to each one."""
    led = with_leads(in_ranges(rows.withColumns(columns), key, order), key, order, known=list(columns))
    return rows_only(led.withColumns({c: F.last(c, ignorenulls=True).over(so_far(key, order)) for c in columns})).drop("__range")
