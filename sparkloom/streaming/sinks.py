"""Stream sinks that a replayed batch does not change: an append log, and an upsert table kept as a log of changes over a base.

A batch writes one folder named by its number, over whatever an earlier attempt left there, so exactly what the last attempt wrote counts. An upsert
table never rewrites rows: changes are appended, the newest of each key is found by an aggregate, and ``compact`` folds them into a new base now and then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.index import upsert

WIDTH = 12


class AppendLog:
    """Rows as they came, for audit trails and page events. The folder ``path`` lies in a store that all machines share."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema

    def _batches(self, folder: str) -> list[int]:
        """Numbers of the finished folders, in order: a listing of one level, of folders and no data."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        found = [x.getPath() for x in files.listStatus(root)]
        done = [p for p in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done)

    def _read(self, folder: str, numbers: Sequence[int]) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{folder}/{n:0{WIDTH}d}" for n in numbers))

    def write(self, batch: DataFrame, number: int) -> None:
        """What foreachBatch calls; the same number twice leaves the second attempt's rows alone."""
        batch.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/changes/{number:0{WIDTH}d}")

    def rows(self) -> DataFrame:
        return self._read("changes", self._batches("changes"))

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Write a stream to the log; with ``once``, what is there now and no more."""
        writer = stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


class UpsertLog(AppendLog):
    """The last row of each key, by ``order`` within a batch and by batch between them."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], order: list[str]) -> None:
        super().__init__(spark, path, schema)
        self.keys, self.order = keys, order

    def _base(self) -> int:
        """The last batch that the newest base holds, or -1."""
        return max(self._batches("base"), default=-1)

    def rows(self) -> DataFrame:
        base = self._base()
        later = [n for n in self._batches("changes") if n > base]
        table = self._read("base", [base] if base >= 0 else [])
        if not later:
            return table
        tagged = None
        for n in later:
            part = self._read("changes", [n]).withColumn("__batch", F.lit(n).cast("long"))
            tagged = part if tagged is None else tagged.unionByName(part)
        newest = upsert(tagged.limit(0), tagged, self.keys, ["__batch", *self.order])
        return table.join(newest.select(*self.keys), self.keys, "left_anti").unionByName(newest.drop("__batch"))

    def compact(self) -> None:
        """Fold all finished batches into a new base. The old base and changes stay until the new one is whole; a second run writes the same base."""
        done = self._batches("changes")
        if done and done[-1] > self._base():
            self.rows().write.mode("overwrite").parquet(f"{self.path}/base/{done[-1]:0{WIDTH}d}")
