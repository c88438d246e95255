"""Global orders in two levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.operators.store import kept


def numbered(rows: DataFrame, order: Sequence[Column], into: str) -> DataFrame:
    """``rows`` with their places from 1 on in the total order ``order``, which has to be one without ties.

    Rows are laid out in stored ranges of the order and numbered inside each; a range's offset is a running sum over the ranges' counts.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__rows"))
    offsets = counts.select("__range", (F.sum("__rows").over(Window.orderBy("__range")) - F.col("__rows")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn(into, inside).join(F.broadcast(offsets), "__range").withColumn(into, F.col(into) + F.col("__before")).drop("__range", "__before")
