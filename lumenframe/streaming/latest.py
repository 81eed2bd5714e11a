"""A sink that keeps the newest row of each key, written so that a batch may be written again.

Every micro-batch becomes one folder that is named by its number and overwritten when the batch comes again after a failure. So
the cost of a batch follows its own size. Readers take the newest row over all folders; ``compact`` folds folders
into one, and readers pass over those it has folded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.streaming.tracker import latest_state


class LatestTable:
    """The newest row of each key by order, whose columns must tell rows of a key apart."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str]):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order

    def folders(self, kind: str) -> list[int]:
        """Numbers of the finished folders of a kind, ascending."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(int(f.getPath().getParent().getName().rpartition("=")[2]) for f in found or ())

    def parts(self) -> list[str]:
        """Folders that make up the table: the last compacted one, and the batches after it."""
        base = max(self.folders("base"), default=-1)
        return [f"{self.path}/base={n}" for n in ([base] if base >= 0 else [])] + [f"{self.path}/batch={n}" for n in self.folders("batch") if n > base]

    def write(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch; a batch that comes again takes the place of what it wrote before."""
        if number <= max(self.folders("base"), default=-1):
            return  # it is in the compacted folder
        latest_state(batch, self.keys, self.order).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def read(self) -> DataFrame:
        return latest_state(self.spark.read.parquet(*self.parts()), self.keys, self.order)

    def compact(self) -> None:
        """Fold all finished batches into one folder."""
        if batches := self.folders("batch"):
            self.read().write.mode("overwrite").parquet(f"{self.path}/base={batches[-1]}")


def newest_frames(table: LatestTable, source: str, order: list[str]):
    """A foreachBatch function: of a batch, only the newest frame of each source goes on; what it overtook is dropped.

    With a bounded trigger this keeps a slow consumer no more than one batch behind, however fast frames come.
    """

    def take(batch: DataFrame, number: int) -> None:
        newest = latest_state(batch, [source], order)
        newest.write.mode("overwrite").parquet(f"{table.path}/taken/batch={number}")
        table.write(newest, number)

    return take
