"""Live views: keyed tables that a stream keeps up to date, batch by batch.

A view is a folder of parts (by a hash of the key), each with a table for every micro-batch that touched it, of which the last one counts. A batch
reads the parts that it touches as they were before it, merges its changes and writes them again under its own number. Played twice, it
reads and writes the same. Older tables of a part go once two newer ones are there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.operators.store import kept

PARTS = 16
#: Micro-batches in which a table is replayed into a view, at most. A batch whose keys are spread rewrites the whole view, so the work of a replay
#: grows with the table only while the number of batches doesn't; rows of a batch are spread over tasks, however many there are.
BATCHES = 8


class View:
    """A keyed table at ``path`` with the columns ``schema`` (DDL), in ``parts`` parts by ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str], parts: int = PARTS):
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), list(key), parts
        self.schema = spark.createDataFrame([], schema).schema

    def _tables(self) -> dict[int, list[int]]:
        """The batches of each part that have a table, ascending: at most three for each part."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        out: dict[int, list[int]] = {}
        for f in found:
            batch, part = f.getPath().getParent(), f.getPath().getParent().getParent()
            out.setdefault(int(part.getName().split("=")[1]), []).append(int(batch.getName().split("=")[1]))
        return {p: sorted(b) for p, b in out.items()}

    def _read(self, tables: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/part={p}/batch={b}" for p, b in sorted(tables.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def current(self) -> DataFrame:
        return self._read({p: b[-1] for p, b in self._tables().items()})

    def part_of(self) -> object:
        return F.pmod(F.hash(*self.key), F.lit(self.parts))

    def change(self, changes: DataFrame, batch_id: int, merge: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """Merges ``changes`` (stored, with the view's columns) as batch ``batch_id``; ``merge`` makes one row for each key of old and new ones. Returns the touched parts before and after."""
        touched = [r["p"] for r in changes.select(self.part_of().alias("p")).distinct().collect()]  # at most ``parts`` numbers
        tables = self._tables()
        before = self._read({p: older[-1] for p in touched if (older := [b for b in tables.get(p, []) if b < batch_id])})
        after = kept(merge(before.unionByName(changes.select(*before.columns))).select(*before.columns).withColumn("__part", self.part_of()), "view", "__part")
        for p in touched:
            after.where(F.col("__part") == p).drop("__part").write.mode("overwrite").parquet(f"{self.path}/part={p}/batch={batch_id}")
            for b in [b for b in tables.get(p, []) if b < batch_id][:-1]:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/part={p}/batch={b}")
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return before, after.drop("__part")


def newest(key: Sequence[str], version: str) -> Callable[[DataFrame], DataFrame]:
    """Of a key's rows the one of the highest version."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in key and c != version]
        return rows.groupBy(*key).agg(F.max(F.struct(version, *rest)).alias("m")).select(*key, "m.*")

    return merge


def added(key: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """The sums of a key's rows."""
    return lambda rows: rows.groupBy(*key).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in key])


class LiveList:
    """A list of rows by id with totals by group, both kept by one stream of changes.

    Changes have the list's columns, among them the ``key``, a ``version`` and ``deleted``; a deleted row stays as a mark, so that older changes that
    come late can't bring it back. ``totals`` counts the rows of each group that are there. Both tables go by batch number.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str], version: str, groups: Sequence[str], parts: int = PARTS):
        self.version, self.groups = version, list(groups)
        self.rows = View(spark, f"{path}/rows", schema, key, parts)
        kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema}
        self.sums = View(spark, f"{path}/totals", ", ".join([*(f"{g} {kinds[g]}" for g in groups), "n long"]), groups, 1)

    def batch(self, changes: DataFrame, batch_id: int) -> None:
        """One micro-batch, for ``foreachBatch``."""
        stored = kept(newest(self.rows.key, self.version)(changes), "changes")
        before, after = self.rows.change(stored, batch_id, newest(self.rows.key, self.version))
        counted = lambda df, n: df.where("NOT deleted").groupBy(*self.groups).agg((F.count("*") * n).alias("n"))
        # parts are whole, so what a group gained is its rows in the touched parts now less those before
        gained = kept(counted(after, 1).unionByName(counted(before, -1)).groupBy(*self.groups).agg(F.sum("n").alias("n")), "gained")
        self.sums.change(gained, batch_id, added(self.groups))

    def follow(self, changes: DataFrame, checkpoint: str) -> None:
        """Takes in all that the stream ``changes`` has now; goes on from ``checkpoint``."""
        changes.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(self.batch).start().awaitTermination()

    def current(self) -> DataFrame:
        return self.rows.current().where("NOT deleted")

    def totals(self) -> DataFrame:
        return self.sums.current().where("n <> 0")
