"""Result tables of a stream: additive totals as one snapshot per micro-batch.

``foreachBatch`` may run a batch again after a failure. Every table is therefore written to a
folder named by the batch id and overwritten on a repeat; totals are computed from the last
snapshot before the batch, so a repeat gives the same totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def batch_ids(spark: SparkSession, path: str) -> list[int]:
    """The ids of the batches written under ``path``, on whatever file system it is."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [status.getPath().getName() for status in files.listStatus(root)]
    return sorted(int(name.split("=", 1)[1]) for name in names if name.startswith("batch_id="))


def drop_batches(spark: SparkSession, path: str, keep: int) -> None:
    """Delete all but the last ``keep`` batches: of a finished batch only the next one reads anything."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for batch_id in batch_ids(spark, path)[:-keep]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={batch_id}"), True)


def write_batch(df: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Write one batch's rows, replacing an earlier attempt; returns the written rows."""
    target = f"{path}/batch_id={batch_id}"
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def latest_batch(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the last batch written under ``path``."""
    ids = batch_ids(spark, path)
    return spark.read.parquet(f"{path}/batch_id={ids[-1]}") if ids else None


class Totals:
    """A table of running totals: ``keys`` and columns merged by sum, min or max."""

    def __init__(self, path: str, keys: Sequence[str], columns: Mapping[str, str]):
        self.path, self.keys, self.columns = path, list(keys), dict(columns)

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        earlier = [b for b in batch_ids(spark, self.path) if b < batch_id]
        return spark.read.parquet(f"{self.path}/batch_id={earlier[-1]}") if earlier else None

    def latest(self, spark: SparkSession) -> DataFrame | None:
        return latest_batch(spark, self.path)

    def replace(self, total: DataFrame, batch_id: int) -> DataFrame:
        """Totals counted anew over everything up to this batch take the place of the sums."""
        merged = [_MERGE[how](name).alias(name) for name, how in self.columns.items()]
        grouped = total.groupBy(*self.keys).agg(*merged) if self.keys else total.agg(*merged)
        return write_batch(grouped, self.path, batch_id)

    def add(self, delta: DataFrame, batch_id: int) -> DataFrame:
        delta = delta.select(*self.keys, *self.columns)
        earlier = self.before(delta.sparkSession, batch_id)
        both = delta if earlier is None else earlier.select(*delta.columns).unionByName(delta)
        merged = [_MERGE[how](name).alias(name) for name, how in self.columns.items()]
        total = both.groupBy(*self.keys).agg(*merged) if self.keys else both.agg(*merged)
        return write_batch(total, self.path, batch_id)
