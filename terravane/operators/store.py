"""Where intermediate tables go, and how the executors get this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, as in tests on one machine, a new one of this session's own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(spark, "_terravane_store", None) or "file://" + tempfile.mkdtemp(prefix="spark-terravane-")
        spark._terravane_store = at
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}"


def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df``, written as a table in the shared folder, in folders by the columns ``by``, and read back. It goes when the application ends, or by ``dropped``."""
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.partitionBy(*by).parquet(path)
    at_exit(df.sparkSession, path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._terravane_path = path
    return back


def at_exit(spark: SparkSession, path: str) -> None:
    """Deletes ``path`` when the driver ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``kept`` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_terravane_path", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors' Python, once for a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_terravane_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    folder = Path(tempfile.mkdtemp(prefix="spark-terravane-"))
    with zipfile.ZipFile(folder / "terravane.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(folder / "terravane.zip"))
    context._terravane_shipped = True
