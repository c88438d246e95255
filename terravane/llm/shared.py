"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terravane.llm.textkernel import slices
from terravane.operators.store import shared_path, ship


def new_path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df``, written as a table and read back: cuts the lineage, and what follows knows its true size."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._terravane_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_terravane_path", None):
            spark = df.sparkSession
            jvm = spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of an Arrow batch of texts, at most; Spark's own bound of a batch's bytes holds beside it.
BATCH_ROWS = 2000


def batches(df: DataFrame) -> DataFrame:
    """``df`` as it is; the session's Arrow batches get no more than BATCH_ROWS rows, so that long texts fit (a lower setting stays), and the executors get this package."""
    spark = df.sparkSession
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    ship(spark)
    return df


def annotate(docs: DataFrame, keep: Sequence[str], text: str, results: dict[str, str], of_texts: Callable[[pa.Array], list[pa.Array]], most: int, prefix: str = "") -> DataFrame:
    """The columns ``keep`` as they are, and what ``of_texts`` makes of the text column, in slices of about ``most`` bytes.

    ``results`` names the new columns and their types; ``prefix`` is put before the names, for tables that have such columns.
    """
    batches(docs)
    names = [prefix + c for c in results]
    if clash := set(names) & set(keep):
        raise ValueError(f"columns {sorted(clash)} are there already: give a prefix")
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text")) if text not in keep or docs.schema[text].dataType.simpleString() != "string" else docs.select(*keep)
    at = rows.columns.index("__text" if "__text" in rows.columns else text)
    n = len(keep)

    def of_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j in slices(batch.column(at), most):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(n)), *of_texts(part.column(at))], names=[*part.schema.names[:n], *names])
        pa.default_memory_pool().release_unused()  # a worker stays for other tasks

    schema = StructType([*rows.schema.fields[:n], *StructType.fromDDL(", ".join(f"`{prefix + c}` {kind}" for c, kind in results.items())).fields])
    return rows.mapInArrow(of_batches, schema)
